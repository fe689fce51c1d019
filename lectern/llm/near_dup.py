"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

Text is lower-cased in A-Z; words are runs of characters other than space and \\t..\\r; a document's set holds its distinct
five-word shingles (with fewer words, the whole sequence as one). Documents with 100 * intersection >= 75 * union are linked;
a component's least doc_id names it.

1. Documents with the same words form a class; from here on a class counts once.
2. Tensored banding: two small collections of band hashes are made, LEFT bands of two minhashes and RIGHT bands of one, and
   every pair of a left and a right band is a table key. LEFT + RIGHT bands give LEFT * RIGHT tables: 31 minhashes stand for
   the 252 that independent tables would take. At similarity 0.75 a pair meets in no table with probability
   (1 - 0.75**2)**12 + (1 - 0.75)**7 = 0.0001, at 0.8 with 0.00002.
3. Within a table key, members are tied to the key's least and greatest member only, never to each other, and a tie holds if
   the minhashes agree in AGREE places or more (a pair at 0.75 agrees in fewer once in ten million). Components of the ties are
   families: all that may be linked lies within one.
4. A family's full sets are packed in blocks of bounded size, and each block is compared within itself by counting common shingles.
   Each document is then linked with the least one of its component there, so rows stay linear in a block's documents. In families of several blocks one
   document of each component is compared with the others' next; as a family of near copies is mostly one component by then, only
   pairs of blocks that still hold different components are compared in full, each pair in a task of its own.
5. Components of the links are the result.

Shingles are 64-bit hashes of whole shingles; two different shingles of a pair of documents agree with probability 1e-13.

Defined cases: a null or blank text has an empty set and is linked with nothing; rows with a null doc_id get component_id
null, are kept and link nothing; rows that share a doc_id are one document, whose texts' links all count; an empty table gives
an empty result; other columns are ignored (link) or kept (keep_one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import join_few, join_shuffled, written
from lectern.llm.graph import components

WORDS = 5
PERCENT = 75
LEFT, RIGHT = 12, 7
HASHES = 2 * LEFT + RIGHT
AGREE = 8
#: Shingles and documents to a block, on average.
BLOCK_SHINGLES, BLOCK_DOCS = 250_000, 1024
_MEMO = 1_000_000

_RANDOM = np.random.default_rng(20_240_229)
_ODD = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RANDOM.integers(0, 2**64, HASHES, dtype=np.uint64)
_SPREAD = _RANDOM.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a document."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        return _mixed(np.array([int((h * _SPREAD[: len(h)]).sum()) + len(h) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    total = h[:n] * _SPREAD[0]
    for k in range(1, WORDS):
        total += h[k : k + n] * _SPREAD[k]
    return np.unique(_mixed(total))


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 65_536):
        least = np.minimum(least, ((found[at : at + 65_536, None] ^ _XOR) * _ODD).min(axis=0))
    return _mixed(least)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    memo = _WordHashes()
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            words = words_of(text)
            found = shingles(words, memo)
            if not len(found):
                rows.append((None, 0, None, None, None))
                continue
            m = minhashes(found)
            left = (m[: 2 * LEFT : 2] * np.uint64(3) ^ m[1 : 2 * LEFT : 2]).view(np.int64)
            rows.append((hashlib.md5(b" ".join(words)).digest(), len(found), left, m[2 * LEFT :].view(np.int64), (m & np.uint64(0xFFFF)).astype("<u2").tobytes()))
        yield pd.concat([pdf[["doc_id"]].astype("Int64"), pd.DataFrame(rows, columns=["cls", "n", "l", "r", "sig"], index=pdf.index)], axis=1)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = _WordHashes()
    for pdf in batches:
        blobs = [shingles(words_of(t), memo) for t in pdf["text"]]
        yield pd.DataFrame({"family": pdf["family"], "doc_id": pdf["doc_id"], "n": [len(b) for b in blobs], "set": [b.tobytes() for b in blobs]})


def common_counts(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Matrix of intersection sizes of all sets; with split, of the first `split` sets with the others."""
    k = len(sets) if split is None else split
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, int)
    size = np.diff(np.r_[first, len(every)])
    rows, cols = (len(sets), len(sets)) if split is None else (k, len(sets) - k)
    shift = 0 if split is None else k
    out = np.zeros((rows, cols), np.int64)
    for width in range(2, 17):  # shingles of few documents: their pairs, all shingles of one width at once
        at = first[size == width]
        if not len(at):
            continue
        m = doc[at[:, None] + np.arange(width)]
        for i in range(width):
            for j in range(width):
                a, b = m[:, i], m[:, j] - shift
                ok = (a < rows) & (b >= 0)
                np.add.at(out, (a[ok], b[ok]), 1)
    wide = np.flatnonzero(size > 16)
    for some in np.array_split(wide, max(1, len(wide) * len(sets) // 16_000_000 + 1)):
        if len(some):
            x = np.zeros((len(sets), len(some)), np.float32)
            for c, s in enumerate(some):
                x[doc[first[s] : first[s] + size[s]], c] = 1
            out += (x @ x.T if split is None else x[:k] @ x[k:].T).astype(np.int64)
    return out


def roots(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> list[int]:
    """For each of n nodes the least one that the pairs connect it with."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for one, two in zip(pdf["one"], pdf["two"], strict=True):
            docs = sorted([*one], key=lambda d: d["doc_id"]) + sorted(two if two is not None else [], key=lambda d: d["doc_id"])
            ids, sets = [d["doc_id"] for d in docs], [np.frombuffer(d["set"], np.uint64) for d in docs]
            split = None if two is None else len(one)
            n = np.array([len(s) for s in sets])
            common = common_counts(sets, split)
            union = n[:, None] + n[None, :] - common if split is None else n[:split, None] + n[None, split:] - common
            a, b = np.nonzero(100 * common >= PERCENT * union)
            if split is None:
                a, b = a[a < b], b[a < b]
            else:
                b = b + split
            found += [(ids[x], ids[y]) for x, y in enumerate(roots(a, b, len(ids))) if x != y]
        yield pd.DataFrame(found, columns=["u", "v"]).astype("int64")


def agreement(a, b):
    """Places in which two sketches agree."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        m = [np.frombuffer(b"".join(s), "<u2").reshape(len(s), HASHES) for s in (x, y)]
        return pd.Series((m[0] == m[1]).sum(axis=1).astype("int32"))

    return run(a, b)


def _packed(sets: DataFrame) -> DataFrame:
    """family, blocks, block and one, the block's documents; a family has as many blocks as its shingles and documents take."""
    size = sets.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).alias("blocks"))
    large = written(size.where("blocks > 1"), "near-large")
    placed = join_few(sets, large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    return placed.groupBy("family", "blocks", "block").agg(F.collect_list(F.struct("doc_id", "set")).alias("one"))


def _inside(packed: DataFrame) -> DataFrame:
    return packed.select("one", F.lit(None).cast(packed.schema["one"].dataType).alias("two")).mapInPandas(_links, "u long, v long")


def _confirmed(sets: DataFrame) -> DataFrame:
    """u, v: links, on full sets, that join all that is to be joined within each family."""
    packed = written(_packed(sets), "near-blocks")
    found = written(_inside(packed), "near-inside")
    several = packed.where("blocks > 1")
    if several.isEmpty():
        return found
    place = written(several.select("family", "blocks", "block", F.explode("one.doc_id").alias("doc_id")), "near-places")
    root = lambda links, node: links.select(F.col("u").alias(node), F.col("v").alias(f"{node}_root"))
    part = written(join_few(place, root(found, "doc_id"), "doc_id", "left").withColumn("head", F.coalesce("doc_id_root", "doc_id")), "near-heads")
    heads = join_few(sets, part.where("head = doc_id").select("doc_id"), "doc_id", "left_semi")
    more = written(_inside(_packed(heads)), "near-head-links")
    found = found.unionByName(more)
    part = join_few(part, root(more, "head"), "head", "left").withColumn("part", F.coalesce("head_root", "head"))
    parts = written(part.groupBy("family", "blocks", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi")), "near-block-parts")
    other = parts.select("family", F.col("block").alias("second"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = parts.withColumn("second", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("second > block")
    pairs = join_few(pairs, other, ["family", "second"], "inner")
    pairs = written(pairs.where(F.greatest("hi", "hi2") > F.least("lo", "lo2")).select("family", "block", "second"), "near-pairs")
    one, two = several.select("family", "block", "one"), several.select("family", F.col("block").alias("second"), F.col("one").alias("two"))
    across = join_shuffled(join_shuffled(one, pairs, ["family", "block"]), two, ["family", "second"]).select("one", "two")
    return found.unionByName(written(across.mapInPandas(_links, "u long, v long"), "near-across"))


def link(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = written(own.mapInPandas(_sketch, "doc_id long, cls binary, n long, l array<long>, r array<long>, sig binary"), "near-sketches")
    real = sketched.where("doc_id is not null and n > 0")
    classes = written(real.groupBy("cls").agg(F.min("doc_id").alias("cid"), *(F.first(c).alias(c) for c in ("l", "r", "sig")), F.count("*").alias("rows")), "near-classes")

    left = classes.select("cid", F.posexplode("l").alias("i", "a"), "r")
    keys = left.select("cid", "i", "a", F.posexplode("r").alias("j", "b")).select("cid", F.xxhash64("i", "a", "j", "b").alias("key"))
    shared = keys.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi")
    ties = join_shuffled(keys, shared, "key").select("cid", F.explode(F.array("lo", "hi")).alias("to")).where("cid <> to")
    ties = ties.select(F.greatest("cid", "to").alias("u"), F.least("cid", "to").alias("v")).distinct()
    sig = lambda c: classes.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{c}"))
    near = join_shuffled(join_shuffled(ties, sig("u"), "u"), sig("v"), "v").where(agreement(F.col("sig_u"), F.col("sig_v")) >= AGREE).select("u", "v")
    tied = components(near, "near-ties")
    member = written(tied.select(F.col("node").alias("doc_id"), F.col("root").alias("family")).unionByName(tied.select(F.col("root").alias("doc_id"), F.col("root").alias("family")).distinct()), "near-members")

    sets = written(join_few(own, member, "doc_id", "inner").mapInPandas(_sets, "family long, doc_id long, n long, set binary"), "near-sets")
    found = _confirmed(sets)
    rooted = components(found, "near-links")

    named = join_few(sketched, written(real.groupBy("cls").agg(F.min("doc_id").alias("cid"), F.count("*").alias("_n")).where("_n > 1").select("cls", "cid"), "near-copies"), "cls", "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("cid", "doc_id").alias("node"))
    out = join_few(named, rooted, "node", "left")
    comp = F.coalesce("root", "node")
    comp = F.when(F.col("doc_id").isNotNull(), comp)
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document of each component, all columns; of rows that repeat a kept doc_id, one stays."""
    gone = written(link(docs, text).where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "near-gone")
    own = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"))
    left = join_few(own, gone, "_id", "left_anti")
    again = written(left.where("_id is not null").groupBy("_id").count().where("count > 1").select("_id"), "near-again")
    if again.isEmpty():
        return left.select("_doc.*")
    once = join_few(left, again, "_id", "left_semi").groupBy("_id").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc"))
    return join_few(left, again, "_id", "left_anti").select("_doc.*").unionByName(once.select("_doc.*"))

