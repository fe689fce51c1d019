"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; each of its documents is to be taken target/source_size times, which lies between 0 and
2. The whole part is fixed; the rest is a fractional copy probability. The pivotal step takes two documents with fractions,
moves words between them at random, without changing the sum of size times probability nor either expectation, until one of
them is 0 or 1, and goes on with the other. So a source's words stay at its target up to one last document.

The steps form a reduction tree: documents fall into buckets by a hash of (source, doc_id, seed), each bucket is folded as
a stream and leaves at most one fractional document, and these residuals are combined, FAN buckets at a time, until each
source has one, which is rounded by its own random number. A fold holds one document in memory, whatever the bucket's size.
All random numbers are hashes of the ids and the seed, so reruns agree, whatever the partitions.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share 150 % of all words; a target stops at
twice its source's words and the excess is shared again by weight until none is above. That is, a source gets its weight times
a level that all free sources share; the level rises as sources reach twice their words, and each step is one sum over the table
of sources. Sources may be as many as documents: only sums reach the driver, and that table is broadcast only if it is small.

Defined cases: a null or blank text has size 0 and is taken 0 times (0 words either way); a null source is a source of its
own, the last; rows that repeat a doc_id, or have none, are separate documents with decisions of their own (rows equal in doc_id,
source and text share out their copies in the order of a hash of all their columns); an empty table gives an empty result; other
columns are ignored (mix) or kept (repeat_documents).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, join_few, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 11
#: Documents to a first bucket, and buckets combined into one, on average.
BUCKET = 4096
FAN = 256
#: Sources to a range in which they are ranked.
RANGE = 100_000

_COLUMNS = "doc_id long, ord long, tie long, source string, size long, whole long, p double, bucket long, done boolean"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size, rows) with target, each source's words to be taken."""
    unknown = F.col("source").isNull().alias("_null")
    n = max(1, -(-sources.count() // RANGE))
    dealt = written(sources.withColumn("_null", unknown).repartitionByRange(n, "_null", "source").withColumn("_cell", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    cells = dealt.groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_null", "source")) - 1 + F.col("_before")
    ranked = dealt.join(cells, "_cell").withColumn("_weight", F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int")))
    ranked = written(ranked.select(*sources.columns, "_weight"), "mix-sources")

    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("_weight") > cap * F.col("source_size")
        of = ranked.select("source_size", "_weight", over.alias("_over")).agg(
            F.sum("source_size"), F.sum(F.when(F.col("_over"), F.col("source_size"))), F.sum(F.when(~F.col("_over"), F.col("_weight"))), F.count_if("_over")
        )
        words, full, free, now = of.first()
        if now == stopped or not free:
            break
        level, stopped = (share * words - cap * (full or 0)) / free, now
    aim = F.least(F.lit(level or 0.0) * F.col("_weight"), cap * F.col("source_size")) if level is not None else F.lit(0.0)
    return ranked.select(*sources.columns, aim.alias("target"))


def _pair(p: float, a: int, q: float, b: int, u: float) -> tuple[float, float]:
    """One pivotal step for probabilities p, q of sizes a, b with the random number u: one of the results is 0 or 1."""
    up = min((1 - p) * a, q * b)  # words that can move to the first
    down = min(p * a, (1 - q) * b)
    if u * (up + down) < down:
        return (1.0 if (1 - p) * a <= q * b else p + up / a), (0.0 if q * b <= (1 - p) * a else q - up / b)
    return (0.0 if p * a <= (1 - q) * b else p - down / a), (1.0 if (1 - q) * b <= p * a else q + down / b)


def _unit(*parts: int) -> float:
    """A number in [0, 1) from integers (splitmix64 finaliser)."""
    x = 0x9E3779B97F4A7C15
    for part in parts:
        x = (x ^ (part & 0xFFFFFFFFFFFFFFFF)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
    return x / 2.0**64


def _fold(level: int, seed: int):
    """Folds rows sorted by (source, bucket, ord, doc_id, size, tie); each (source, bucket) leaves one fractional row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = None, None
        for pdf in batches:
            out = []
            pdf = pdf.astype({"doc_id": "Int64"})
            for row in pdf.itertuples(index=False):
                now = (None if pd.isna(row.source) else row.source, row.bucket)
                if held is not None and now != key:
                    out.append(held)
                    held = None
                key = now
                row = row._replace(p=float(row.p))
                if row.done:
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    u = _unit(seed, level, held.ord, row.ord, held.tie, row.tie, held.size, row.size)
                    p, q = _pair(held.p, held.size, row.p, row.size, u)
                    one, two = held._replace(p=p), row._replace(p=q)
                    if 0 < p < 1:
                        held, full = one, two
                    elif 0 < q < 1:
                        held, full = two, one
                    else:
                        out.append(one._replace(done=True))
                        held, full = None, two
                    out.append(full._replace(done=True))
            if out:
                yield pd.DataFrame(out, columns=pdf.columns)
        if held is not None:
            yield pd.DataFrame([held], columns=list(held._fields))

    return run


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words) and tie (a hash of the text) of every row."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n.alias("size"), F.xxhash64(text).alias("tie"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", seed: int = SEED, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and tie (a hash of the text) of every row."""
    sizes = written(sized(docs, text, source), "mix-sizes")
    plan = written(targets(written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-words")), "mix-plan")
    most = max(1, (plan.agg(F.max("rows")).first()[0] or 0) // bucket)
    key = F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null")
    plan = plan.select(*key, "source_size", "target", F.greatest(F.lit(1), F.floor(F.col("rows") / bucket)).cast("long").alias("buckets"))
    noted = join_few(sizes.select(*sizes.columns, *key), plan, ["_s", "_null"], "inner", F.octet_length("_s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate).cast("long")
    ord_ = F.xxhash64("_s", "_null", "doc_id", F.lit(seed))
    part = rate - whole
    open_ = noted.select(
        "doc_id", ord_.alias("ord"), "tie", "source", "size", whole.alias("whole"), part.alias("p"),
        F.pmod(F.shiftright(F.xxhash64(ord_, "tie"), 8), F.col("buckets")).alias("bucket"), ((F.col("size") == 0) | (part <= 0)).alias("done"),
    )
    settled, level = [], 0
    while True:
        if level:
            open_ = open_.withColumn("bucket", F.expr(f"bucket div {fan}"))
        dealt = open_.repartition(F.coalesce("source", F.lit("")), F.col("source").isNull(), "bucket")
        folded = written(dealt.sortWithinPartitions("source", "bucket", "ord", "doc_id", "size", "tie").mapInPandas(_fold(level, seed), _COLUMNS), f"mix-{level}")
        settled.append(folded.where("done"))
        open_ = folded.where("not done")
        if most <= 1:
            break
        level, most = level + 1, -(-most // fan)
    last = F.pmod(F.xxhash64("ord", F.lit(seed + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    settled.append(open_.withColumn("p", F.when(last < F.col("p"), 1.0).otherwise(0.0)))
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("long")).otherwise(F.lit(0).cast("long"))
    out = every.select("doc_id", "source", "size", copies.alias("copies"), "tie", *key)
    out = join_few(out, plan.drop("buckets"), ["_s", "_null"], "inner", F.octet_length("_s"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tie")


def repeat_documents(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; its columns stay as they are."""
    key = ["_own", "_id", "_some", "_s", "_tie"]
    of = lambda doc_id, source, tie: (
        doc_id.isNotNull().alias("_own"), F.coalesce(doc_id, F.lit(0)).alias("_id"), source.isNotNull().alias("_some"), F.coalesce(source, F.lit("")).alias("_s"), tie.alias("_tie")
    )
    taken = mix(docs, text, source).select(*of(F.col("doc_id"), F.col("source"), F.col("tie")), "copies").groupBy(*key).agg(
        F.count("*").alias("_rows"), F.count_if(F.col("copies") >= 2).alias("_twice"), F.count_if(F.col("copies") >= 1).alias("_once")
    )
    taken = written(taken.where("_once > 0"), "mix-taken")
    own = docs.select(F.struct("*").alias("_doc"), *of(F.col("doc_id").cast("long"), F.col(source).cast("string"), F.xxhash64(text)))
    out = join_few(own, taken, key, "inner", F.octet_length("_s") + 24)
    same = F.col("_rows") > 1  # rows that are equal but for other columns share out what they are taken
    alone = out.where(~same).withColumn("_k", F.lit(1))
    if not taken.where(same).isEmpty():
        alone = alone.unionByName(out.where(same).withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_doc")))))
    copies = F.when(F.col("_k") <= F.col("_twice"), 2).when(F.col("_k") <= F.col("_once"), 1).otherwise(0)
    some = alone.withColumn("_copies", copies).where("_copies > 0")
    return some.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_doc.*")
