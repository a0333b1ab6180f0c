"""Shared storage for intermediate tables.

Every executor must be able to read what another one wrote, so intermediates go to
the folder in ``spark.checkpoint.dir``. A folder of our own is used only where that
setting is absent (tests, notebooks in local mode).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a private one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table; a missing path is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside the block go when their query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES, None)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before) if before is not None else spark.conf.unset(SHUFFLES)


def stash(df: DataFrame, name: str, keep: list[str] | None = None, outside: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage.

    A lost executor then costs a re-read of files, not a recomputation. The path is
    appended to ``keep`` so that a loop can drop tables it no longer needs; inside
    ``scratch`` the table goes with the block unless it is written ``outside``; whatever
    remains is removed when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    register(spark, path, outside)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stashed inside the block are removed at its end; what is left of it must be written ``outside``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            remove(spark, path)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it has at most ``rows`` rows.

    Beyond the bound it is returned as it is, and the planner joins it by shuffle.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_PATHS: list[tuple[SparkSession, str]] = []
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def register(spark: SparkSession, path: str, outside: bool = False) -> None:
    """Remove ``path`` with the block around, or the one around that if ``outside``, else when the process ends."""
    if len(_SCOPES) > outside:
        _SCOPES[-1 - outside].append((spark, path))
        return
    if not _PATHS:
        atexit.register(_clean)
    _PATHS.append((spark, path))


def _clean() -> None:
    for spark, path in _PATHS:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
