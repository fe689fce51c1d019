"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of characters other than these six ASCII blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"

#: Bytes of a side that may be broadcast after measuring it; larger sides join by shuffle. A row's fixed columns count as ROW bytes.
BROADCAST_BYTES, ROW = 16 << 20, 48
#: A key with more than one in so many rows is hot.
HOT_SHARE = 1000


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within the one that driver and executors share (spark.checkpoint.dir).

    Only a local session may do without that setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.setdefault(context.applicationId, "")
        if not where:
            where = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return f"{where.rstrip('/')}/lectern-{context.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this application has written. Results that are still lazy read them: write those first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, gives later plans real sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Steps written inside hand Python at most so many rows at a time: whole texts make heavy rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body is a lambda that runs for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{BLANKS}]+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_shuffled(one: DataFrame, two: DataFrame, key, how: str = "inner") -> DataFrame:
    """one joined with two by shuffle, whatever size Spark takes them to have.

    Spark sizes a table by its compressed files, and what explode makes of it by the rows before, and would broadcast a side that the driver can't hold.
    """
    return one.join(two.hint("merge"), key, how)


def join_few(big: DataFrame, few: DataFrame, key: str | list[str], how: str, extra: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """big joined with a table that is usually small.

    few is measured first, at ROW bytes a row and what `extra` gives besides: up to `limit` bytes it is broadcast; beyond that
    it is a shuffle join, also where Spark takes few for smaller, with AQE splitting skewed keys.
    """
    size = few.agg(F.sum(F.lit(ROW) if extra is None else F.lit(ROW) + extra)).first()[0] or 0
    return big.join(F.broadcast(few), key, how) if size <= limit else join_shuffled(big, few, key, how)


def join_spread(big: DataFrame, few: DataFrame, keys: list[str], rows: str, spread: list[str]) -> DataFrame:
    """big joined (inner) with few, which has one row a key and, in `rows`, how many rows of big have that key.

    Keys with more than a share of 1 / HOT_SHARE of the rows are at most HOT_SHARE, so they are broadcast, and their rows are dealt
    out by the columns `spread` rather than by the key. All others join by shuffle.
    """
    values = [c for c in few.columns if c not in keys]
    total = few.agg(F.sum(rows)).first()[0] or 0
    row = F.struct(*values)
    hot = few.where(F.col(rows) * HOT_SHARE > total).select(*keys, row.alias("_hot"))
    known = big.join(F.broadcast(hot), keys, "left")
    dealt = known.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).cast("long"))
    cold = few.where(F.col(rows) * HOT_SHARE <= total).select(*keys, F.lit(0).cast("long").alias("_salt"), row.alias("_cold"))
    out = dealt.join(cold, [*keys, "_salt"], "left").withColumn("_row", F.coalesce("_hot", "_cold")).where("_row is not null")
    return out.select(*big.columns, *(F.col("_row")[c].alias(c) for c in values))
