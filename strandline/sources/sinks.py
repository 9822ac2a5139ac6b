"""Writers: manifests, CSV exports, and a ledger of versioned Parquet tables with transactions and snapshots."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from strandline.operators.tables import upsert


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines; a NaN or infinite number raises rather than writing text that JSON doesn't know."""
    for field in df.schema.fields:
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.col(field.name)
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            df = df.withColumn(field.name, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{field.name} is not a number")).cast(field.dataType)).otherwise(c))
    df.write.option("ignoreNullFields", False).json(path)


def export_csv(df: DataFrame, path: str, vectors: list[str] = (), drop: list[str] = ()) -> None:
    """CSV with header; vectors as 'yes' or '', nested columns as JSON."""
    out = df.drop(*drop)
    for field in out.schema.fields:
        if field.name in vectors:
            out = out.withColumn(field.name, F.when(F.col(field.name).isNotNull(), "yes").otherwise(""))
        elif field.dataType.typeName() in ("array", "struct", "map"):
            out = out.withColumn(field.name, F.to_json(field.name))
    out.write.option("header", True).csv(path)


class Ledger:
    """Tables as versioned Parquet folders under one root; a small pointer file names each table's current version.

    A transaction stages new versions and moves the pointer once at its end, so
    readers see all of it or nothing, and an error leaves the old state.  Nested
    transactions belong to the outer one.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: dict[str, str] | None = None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _pointers(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("state-"))

    def _state(self) -> dict[str, str]:
        names = self._pointers()
        if not names:
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/{names[-1]}").first()[0])

    def _publish(self, state: dict[str, str]) -> None:
        number = int(self._pointers()[-1].split("-")[1]) + 1 if self._pointers() else 0
        staged = self._path(f"{self.root}/.staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(staged, self._path(f"{self.root}/state-{number:09d}")):
            raise RuntimeError("another writer published first")

    @contextmanager
    def transaction(self) -> Iterator[Ledger]:
        if self._staged is not None:
            yield self
            return
        self._staged = self._state()
        try:
            yield self
            self._publish(self._staged)
        finally:
            self._staged = None

    def table(self, name: str) -> DataFrame | None:
        at = (self._staged if self._staged is not None else self._state()).get(name)
        return None if at is None else self.spark.read.parquet(f"{self.root}/{at}")

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table."""
        with self.transaction():
            at = f"{name}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
            rows.write.parquet(f"{self.root}/{at}")
            self._staged[name] = at

    def append(self, name: str, rows: DataFrame) -> None:
        old = self.table(name)
        self.write(name, rows if old is None else old.unionByName(rows, allowMissingColumns=True))

    def put(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Insert or replace by key."""
        old = self.table(name)
        self.write(name, rows if old is None else upsert(old, rows, keys))

    def log(self, step: str, message: str) -> None:
        self.append("events", self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(step).alias("step"), F.lit(message).alias("message")))

    def snapshots(self) -> list[str]:
        return self._pointers()

    def keep(self, n: int) -> None:
        """Forget all but the newest n states, and the versions that only they name."""
        names = self._pointers()
        read = lambda s: json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/{s}").first()[0])
        live = {v for s in names[-n:] for v in read(s).values()}
        for s in names[:-n]:
            for v in read(s).values():
                if v not in live:
                    self._fs.delete(self._path(f"{self.root}/{v}"), True)
            self._fs.delete(self._path(f"{self.root}/{s}"), False)
