"""Tables in versions: written whole, published by one pointer, newest row of each key read.

    <path>/data/<name>/          rows of one write, Parquet; nobody reads them before they are published
    <path>/published/<number>    a pointer: JSON with the folder, the mode and the schema of a version

A pointer is written beside its place and renamed onto it; a rename that finds the place taken fails, so of two writers that
publish the same number one is told, and readers see a version whole or not at all. A write that fails before publishing leaves a
folder that no pointer names; `vacuum` deletes those. A "replace" version hides all before it; an "upsert" version replaces rows by
key. Reading joins each upsert's keys against the versions before it (anti joins that Spark broadcasts where an upsert is small), so an
upsert never rewrites the table; `compact` writes what readers see as one version.

Defined cases: a key that an upsert holds twice keeps its greatest row by `order` columns (required then); null keys are keys; an
empty upsert changes nothing; a table without versions reads as no rows of the given schema.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder within the one that driver and executors share (spark.checkpoint.dir); only a local session may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, for a plan that reads it more than once: computed once, and not again when executors are lost."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Written:
    """A write that isn't published yet."""

    folder: str
    mode: str
    schema: str


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | str | None = None):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        jvm = spark.sparkContext._jvm
        self._jvm, self._Path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def history(self) -> list[tuple[int, Written]]:
        """Published versions, oldest first."""
        where = self._Path(f"{self.path}/published")
        if not self._fs.exists(where):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(where))
        return [(int(n), self._pointer(n)) for n in names if n.isdigit()]

    def _pointer(self, name: str) -> Written:
        stream = self._fs.open(self._Path(f"{self.path}/published/{name}"))
        try:
            return Written(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def write(self, df: DataFrame, mode: str = "upsert") -> Written:
        """Writes df; readers don't see it before `publish`."""
        if mode not in ("replace", "upsert"):
            raise ValueError(f"mode is replace or upsert, not {mode!r}")
        out = Written(uuid.uuid4().hex, mode, df.schema.json())
        df.write.parquet(f"{self.path}/data/{out.folder}")
        return out

    def publish(self, written: Written, expected: int | None = None) -> int:
        """Makes a write the next version and returns its number. With `expected`, the number of the version that it was made from,
        it fails if another has been published since."""
        last = max((n for n, _ in self.history()), default=0)
        if expected is not None and last != expected:
            raise ValueError(f"version {last} was published after {expected}")
        temporary, place = self._Path(f"{self.path}/publishing/{uuid.uuid4().hex}"), self._Path(f"{self.path}/published/{last + 1:09d}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(written.__dict__).encode()))
        stream.close()
        self._fs.mkdirs(place.getParent())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, place, options)
        return last + 1

    def save(self, df: DataFrame, mode: str = "upsert") -> int:
        return self.publish(self.write(df, mode))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows after a version (the last): the newest of each key."""
        seen = [(n, w) for n, w in self.history() if version is None or n <= version]
        first = max((i for i, (_, w) in enumerate(seen) if w.mode == "replace"), default=0)
        rows = None
        for _, w in seen[first:]:
            own = self.spark.read.schema(StructType.fromJson(json.loads(w.schema))).parquet(f"{self.path}/data/{w.folder}")
            if rows is None:
                rows = own
            else:
                same = [rows[k].eqNullSafe(own[k]) for k in self.keys]
                rows = rows.join(own.select(*self.keys).distinct(), same, "left_anti").unionByName(own, allowMissingColumns=True)
        if rows is None:
            if self.schema is None:
                raise ValueError(f"nothing is published at {self.path}")
            rows = self.spark.createDataFrame([], self.schema)
        return rows

    def upsert(self, df: DataFrame, order: list[str] | None = None) -> int:
        """Publishes df by key; of rows that share a key the greatest by `order` stays."""
        if order:
            others = [c for c in df.columns if c not in self.keys]
            best = df.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
            df = best.select(*self.keys, *(F.col("_row")[c].alias(c) for c in others)).select(*df.columns)
        return self.save(df, "upsert")

    def compact(self) -> int:
        seen = self.history()
        return self.publish(self.write(self.read(), "replace"), seen[-1][0] if seen else 0)

    def vacuum(self) -> list[str]:
        """Deletes folders that no pointer names; no writer may be at work. Gives their names."""
        where = self._Path(f"{self.path}/data")
        if not self._fs.exists(where):
            return []
        named = {w.folder for _, w in self.history()}
        gone = sorted(n for n in (f.getPath().getName() for f in self._fs.listStatus(where)) if n not in named)
        for n in gone:
            self._fs.delete(self._Path(f"{self.path}/data/{n}"), True)
        return gone
