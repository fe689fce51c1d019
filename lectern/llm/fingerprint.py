"""Document fingerprints by winnowing (DataFrame functions only).

Tokens are words (runs of characters other than space and \\t..\\r). The hash of a K-gram is a rolling one: with word hashes h,
H(i) = h(i) << K-1 ^ h(i+1) << K-2 ^ ... ^ h(i+K-1), so H(i+1) = (H(i) ^ h(i) << K-1) << 1 ^ h(i+K). Columns have no running
state, so each is evaluated from its own K words, at the same cost. In every window of WINDOW consecutive K-grams the least hash
(of all 64 bits) is chosen, the rightmost of equals; its hash and position (of its first word) go into the fingerprint. So any
K + WINDOW - 1 consecutive words that two texts share leave a common hash, with its position in both. The least of a window is
found by doubling: from the leasts of windows of 1, 2, 4, 8 that of 16.

A text with fewer than K words has one gram of all its words; with fewer than WINDOW grams, one window of them all.
The fingerprint string lists hash:position (hash in hexadecimal, position in decimal) by position, comma-joined. Likeness is
the share of distinct hashes that two fingerprints have in common, |A and B| / |A or B|; two empty ones are alike (1.0).

The edited text of a document has its last floor(n/2) code points replaced by the first as many of the next document, in
ascending doc_id (after the last comes the first). Which document is next is found on ids, hashes and lengths alone: they are dealt
out by rank, into ranges of about CELL rows whatever gaps the ids have, and each range is ordered by itself. Texts are shuffled once,
and each sends the one before it no more than the first characters that it takes, and its hashes.

Defined cases: null counts as the empty text (no words, fingerprint ""); null doc_ids come first; rows that repeat a doc_id
follow each other in the order of their texts' hashes; equal rows follow each other; a single document is its own next; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import let, words_of, written

K = 5
WINDOW = 16  # a power of 2
#: Rows (of ids, not of texts) to a range.
CELL = 100_000


def _grams(words: Column, k: int) -> Column:
    """Hashes of the k-grams of a word array."""

    def rolled(h: Column, i: Column) -> Column:
        out = F.get(h, i + (k - 1))
        for d in range(k - 1):
            out = out.bitwiseXOR(F.shiftleft(F.get(h, i + d), k - 1 - d))
        return out

    each = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: rolled(h, i)))
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < k, whole).otherwise(each)


def _chosen(grams: Column, window: int) -> Column:
    """Positions of the windows' rightmost least hashes, ascending and distinct."""

    def doubled(x: Column, best: Column, step: int) -> Column:
        """From the places of the least of each `step` hashes, those of each 2 * step; what lies beyond the end is null and never less."""

        def less(a: Column, i: Column) -> Column:
            b = F.get(best, i + step)
            return F.when(F.get(x, b) <= F.get(x, a), b).otherwise(a)

        return F.transform(best, less)

    def of(x: Column, best: Column, step: int) -> Column:
        if step == window:
            return F.array_distinct(F.slice(best, F.lit(1), F.greatest(F.size(x) - window, F.lit(0)) + 1))
        return let(doubled(x, best, step), lambda q: of(x, q, 2 * step))

    at = let(grams, lambda x: let(F.sequence(F.lit(0), F.size(x) - 1), lambda q: of(x, q, 1)))
    return F.when(F.size(grams) == 0, F.array().cast("array<int>")).otherwise(at)


def winnowed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Array of structs (h, p): the chosen hashes and their positions."""
    of = lambda g: let(_chosen(g, window), lambda at: F.transform(at, lambda i: F.struct(F.get(g, i).alias("h"), i.alias("p"))))
    return let(words_of(text), lambda w: let(_grams(w, k), of))


def as_string(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lower(F.hex(m["h"])), F.lit(":"), m["p"].cast("string"))), ",")


def hashes(marks: Column) -> Column:
    return F.transform(marks, lambda m: m["h"])


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of hashes."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


_KEY = ["_own", "_id", "_tie"]


def _order(rows: DataFrame, cell: int) -> DataFrame:
    """For each key (of equal rows) how many rows it has (_m), and key and length of the one before it (_p_own, _p_id, _p_tie, _p_n)."""
    keys = written(rows.groupBy(*_KEY).agg(F.count("*").alias("_m"), F.first("_n").alias("_n")), "next-keys")
    dealt = keys.repartitionByRange(max(1, -(-keys.count() // cell)), *_KEY)
    dealt = written(dealt.withColumn("_cell", F.spark_partition_id()), "next-ranges")
    here = F.struct(*_KEY, "_n")
    ends = dealt.groupBy("_cell").agg(F.max(here).alias("_last"))
    ring = Window.orderBy("_cell")  # one row for each range
    ends = ends.select("_cell", F.coalesce(F.lag("_last").over(ring), F.max("_last").over(Window.partitionBy())).alias("_end"))
    before = F.lag(here).over(Window.partitionBy("_cell").orderBy(*_KEY))
    led = dealt.withColumn("_before", before).join(ends, "_cell").withColumn("_before", F.coalesce("_before", "_end"))
    return led.select(*_KEY, "_m", *(F.col("_before")[c].alias("_p" + c) for c in (*_KEY, "_n")))


def fingerprints(docs: DataFrame, text: str = "text", cell: int = CELL) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.isNotNull().alias("_own"), F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(body).alias("_tie"), F.length(body).alias("_n"), body.alias("text"))
    order = written(_order(rows.drop("text"), cell), "next-order")
    own = rows.drop("_n").join(order, _KEY).withColumn("_k", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.lit(1))))
    head = own.where("_k = 1").select(
        *(F.col("_p" + c).alias(c) for c in _KEY), F.substring(F.col("text"), F.lit(1), F.floor(F.col("_p_n") / 2).cast("int")).alias("_head"), hashes(winnowed(F.col("text"))).alias("_c")
    )
    led = own.join(head, _KEY).withColumn("a", winnowed(F.col("text")))
    again = F.col("_k") < F.col("_m")  # an equal row comes next
    size = F.length("text")  # so both sides of the join read the same columns, of one shuffle
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.when(again, F.substring(F.col("text"), F.lit(1), half)).otherwise(F.col("_head")))
    cut = led.select(F.when(F.col("_own"), F.col("_id")).alias("doc_id"), size.cast("long").alias("n_chars"), "a", F.when(again, hashes(F.col("a"))).otherwise(F.col("_c")).alias("c"), edited.alias("edited"))
    marked = cut.select("doc_id", "n_chars", "a", "c", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnowed(F.col("edited")).alias("b"))
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("a")).alias("fingerprint"), as_string(F.col("b")).alias("edited_fingerprint"),
        likeness(hashes(F.col("a")), hashes(F.col("b"))).alias("near_edited"), likeness(hashes(F.col("a")), F.col("c")).alias("near_next"),
    )
