"""Structured Streaming forms: duplicates within a watermark, windowed counts, rolling admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Rows of a stream, one per key within the watermark; state is dropped as it passes."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, keys: list[str], window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts per window and keys; late rows count until the watermark passes."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def rolling_admission(stream: DataFrame, key: str, at: str, request: str, most: int, seconds: int) -> DataFrame:
    """``(key, request, admitted)``: at most ``most`` admissions per key in ``seconds``; state is those admissions."""
    key_type, request_type = stream.schema[key].dataType.simpleString(), stream.schema[request].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = list(state.get[0]) if state.exists else []
        # the requests of one key in a micro-batch come in several chunks; their order is that of time, not of chunks
        for part in [pd.concat(list(parts)).sort_values([at, request])]:
            answers = []
            for t in part[at].astype("int64") // 1_000_000_000 if str(part[at].dtype).startswith("datetime64[ns") else part[at].map(lambda x: int(x.timestamp())):
                held = [h for h in held if t - h < seconds]
                answers.append(len(held) < most)
                if answers[-1]:
                    held.append(int(t))
            yield pd.DataFrame({key: [k[0]] * len(part), request: part[request].to_numpy(), "admitted": answers})
        state.update((held,))

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, {request} {request_type}, admitted boolean", "held array<bigint>", "append", "NoTimeout")
