"""State tables as versioned snapshots: written whole, validated, published by an atomic pointer.

``<root>/<table>/v=<n>`` holds version n as Parquet, ``after=<n>`` names the version that follows n, and
``CURRENT`` names a published one from which a reader goes on. Giving ``after=<n>`` its name is the one
atomic step: exactly one writer can follow a version. A reader sees the old version or the new one,
never a mixture; the previous valid version stays as backup.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, types as T


class StateError(RuntimeError):
    """State that is missing a part or doesn't pass its checks."""


class Snapshots:
    """Versions of one state table under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType) -> None:
        self.spark, self.base, self.schema = spark, f"{root.rstrip('/')}/{name}", schema
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.base}/{name}")

    def _text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        except (Py4JJavaError, UnicodeDecodeError) as error:
            raise StateError(f"{self.base}: {name} cannot be read") from error
        finally:
            stream.close()

    def version(self) -> int | None:
        """The published version; None if nothing was published; StateError if the pointer is broken."""
        current = 0
        if self.fs.exists(self._path("CURRENT")):
            text = self._text("CURRENT")
            if not text.isdigit() or not self.fs.exists(self._path(f"v={text}")):
                raise StateError(f"{self.base}: the pointer names no version: {text!r}")
            current = int(text)
        # a writer may have ended between naming its version and moving the pointer
        while self.fs.exists(self._path(f"after={current}")):
            current = int(self._text(f"after={current}"))
        return current or None

    def read(self, version: int | None = None) -> DataFrame:
        """The published (or a given) version; an empty table where nothing was published; fails closed otherwise."""
        version = self.version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        if not self.fs.exists(self._path(f"v={version}/_SUCCESS")):
            raise StateError(f"{self.base}: version {version} is incomplete")
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/v={version}")

    def write(self, rows: DataFrame, check: Callable[[DataFrame], int] | None = None, expect: int | None = -1) -> int:
        """Write the next version, check it, publish it; returns its number.

        ``check`` counts violations of the version as written; any makes StateError and nothing is
        published. ``expect`` is the version the caller started from (-1: whatever is current): if
        another writer published since, StateError, and the caller merges and tries again.
        """
        before = self.version()
        if expect != -1 and before != expect:
            raise StateError(f"{self.base}: version {before} was published meanwhile")
        number = (before or 0) + 1
        while self.fs.exists(self._path(f"v={number}")):
            number += 1
        target = f"{self.base}/v={number}"
        rows.select(*self.schema.names).write.mode("errorifexists").parquet(target)
        if check and check(self.spark.read.schema(self.schema).parquet(target)):
            self.fs.delete(self._path(f"v={number}"), True)
            raise StateError(f"{self.base}: version {number} fails its checks")
        self._publish(number, before)
        return number

    def _renamed(self, content: str, name: str, *options: str) -> None:
        """A small file written aside and given its name."""
        jvm = self.spark.sparkContext._jvm
        aside = self._path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        given = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, len(options))
        for i, option in enumerate(options):
            given[i] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, option)
        try:
            context.rename(aside, self._path(name), given)
        except Exception:
            self.fs.delete(aside, False)
            raise

    def _publish(self, number: int, before: int | None) -> None:
        try:
            self._renamed(str(number), f"after={before or 0}")
        except Exception as error:  # noqa: BLE001  the name is taken
            raise StateError(f"{self.base}: another version was published meanwhile") from error
        self._renamed(str(number), "CURRENT", "OVERWRITE")

    def publish(self, merge: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], int] | None = None, attempts: int = 3) -> int:
        """Read, merge and publish; on a concurrent publication read again, at most ``attempts`` times."""
        for attempt in range(attempts):
            version = self.version()
            try:
                return self.write(merge(self.read(version)), check, version)
            except StateError:
                if attempt == attempts - 1 or self.version() == version:
                    raise
        raise StateError("no attempts")

    def recover(self, version: int, target: str, check: Callable[[DataFrame], int] | None = None) -> None:
        """Export a valid version to a folder that doesn't exist yet."""
        rows = self.read(version)
        if check and check(rows):
            raise StateError(f"{self.base}: version {version} fails its checks")
        rows.write.mode("errorifexists").parquet(target)
