"""Reports and an acknowledged, idempotent delivery sink."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import sanitize

DELIVERED, UNCERTAIN, FAILED, PERMANENT = "delivered", "uncertain", "failed", "permanent_failure"


def outcome(status: int | None, timed_out: bool = False) -> str:
    """What a response means for a delivery; a time-out may have been delivered, so it is uncertain."""
    if status is None:
        return UNCERTAIN if timed_out else FAILED
    return DELIVERED if status in (200, 204) else FAILED if status == 429 or 500 <= status < 600 else PERMANENT


def deliver(rows: DataFrame, key: str, order: str, send: Callable[[list[dict]], tuple[int | None, bool]], size: int = 5) -> DataFrame:
    """Send rows in batches of ``size``, one acknowledgement per batch; ``(key, status)``.

    At least once: a batch whose acknowledgement is lost may be sent again, so the receiver must
    know ``key``. Batches are sent where their rows are, without gathering them on the driver.
    """

    def run(parts):
        import pyarrow as pa

        for part in parts:
            rows_ = part.to_pylist()
            for at in range(0, len(rows_), size):
                chunk = rows_[at : at + size]
                status = outcome(*send(chunk))
                yield pa.RecordBatch.from_pydict({key: [r[key] for r in chunk], "status": [status] * len(chunk)})

    return rows.sortWithinPartitions(order).mapInArrow(run, f"{key} string, status string")


def undelivered(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no delivered or permanently failed entry in the log."""
    done = log.where(F.col("status").isin(DELIVERED, PERMANENT)).select(key).distinct()
    return rows.join(done, key, "left_anti")


def delivery_sink(log_path: str, key: str, order: str, send: Callable[[list[dict]], tuple[int | None, bool]]):
    """A ``foreachBatch`` function: sends what the log doesn't have and appends the outcomes to it."""

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        try:
            log = spark.read.schema(f"{key} string, status string").parquet(log_path)
            fresh = undelivered(batch.dropDuplicates([key]), log, key)
        except Exception as error:  # noqa: BLE001  no log yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            fresh = batch.dropDuplicates([key])
        deliver(fresh, key, order, send).write.mode("append").parquet(log_path)

    return write


def write_report(counts: dict, problems: DataFrame, directory: str | Path, most_rows: int = 1000) -> Path:
    """``run.json`` and ``summary.md`` from counts and the first ``most_rows`` problems; contacts are taken out.

    Both say how many problems there are in all.
    """
    strings = [c for c, t in problems.dtypes if t == "string"]
    shown = problems.withColumns({c: sanitize(F.col(c)) for c in strings}).limit(most_rows)
    rows = [r.asDict() for r in shown.collect()]
    total = len(rows) if len(rows) < most_rows else problems.count()
    folder = Path(directory)
    folder.mkdir(parents=True, exist_ok=True)
    new = folder / ".run.json"
    new.write_text(json.dumps({"counts": counts, "problems": rows, "problems_in_all": total}, allow_nan=False, sort_keys=True, default=str), encoding="utf-8")
    new.replace(folder / "run.json")
    lines = ["# Run", "", *[f"- {k}: {v}" for k, v in counts.items()], "", f"{len(rows)} of {total} problems", "", "| " + " | ".join(shown.columns) + " |", "|" + " - |" * len(shown.columns)]
    lines += ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in shown.columns) + " |" for r in rows]
    (folder / "summary.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return folder / "run.json"


