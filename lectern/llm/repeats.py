"""Repeated passages: an enhanced suffix array scanned as a tree of common-prefix intervals.

Texts are UTF-8 bytes; matches don't cross documents. A byte is removed if a string of LENGTH bytes that covers it starts at
another place too, in the same document or another. Passages are told as well: bytes that are covered by such a string, or by one of
PASSAGE to LENGTH bytes that starts at another place too and holds parts of more than WORDS words (runs without ASCII blanks).

1. Equal texts form a class; a class of several rows is removed whole, and counts once from here on.
2. Anchors. Of the GRAM-byte grams in every PASSAGE-byte string, those of least hash are anchors, so equal strings have equal
   anchors at equal places. About one byte in 100 is an anchor. Grams that occur once are dropped by a count. What is left is a
   sparse suffix array: the suffixes that start at anchors, with all that is ever needed of a text on either side of an anchor,
   its context: PASSAGE - GRAM bytes to the left and LENGTH to the right.
3. Equal contexts count once. An anchor whose context occurs again is settled: all strings of its context repeat.
4. The other contexts are dealt out by gram. In a task, a gram's suffixes are sorted, common prefixes of neighbours found, and
   a stack scan visits their intervals from the longest prefix up. An interval keeps its members in the order of their left
   contexts; when two intervals join at prefix length r, each member of the smaller finds its nearest left neighbours in the
   larger, whose common left extension l is the longest. If l + r reaches LENGTH (or PASSAGE, with words enough), both repeat over
   [anchor - l, anchor + r). Members with the same left extension aren't maximal and go on to the enclosing interval. So every occurrence is compared with the best
   of all others, not with its neighbours in the array alone, in O(n log n) steps a gram.
   Grams of more than GROUP different contexts don't go to one task: their strings are counted by hash instead.
5. Spans of the anchors are joined for each class, merged, and cut out.

Grams and contexts that hold more than a thousandth of the anchors are joined by broadcast (there are fewer than a thousand), all
others by shuffle, so no key brings its rows to one task.

groups() returns the maximal repeats themselves, with all their occurrences.

Defined cases: null counts as the empty text; texts shorter than LENGTH bytes hold no string of that length
and lose nothing; equal rows are separate documents (each is the other's repeat); null and repeated doc_ids are allowed; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches, join_few, join_spread, written

LENGTH = 400
GRAM = 48
#: Bytes of a passage at least, and words that it exceeds.
PASSAGE, WORDS = 250, 50
#: Rows to a batch in Python.
BATCH = 1000
#: Different contexts of one gram that a task compares (about 60 MB of text).
GROUP = 100_000

_RANDOM = np.random.default_rng(19_730_401)
_TABLES = _RANDOM.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so they have inverses
_ONE = np.uint64(1)


class _Powers:
    """Powers of the bases and of their inverses, as far as they have been asked for."""

    def __init__(self):
        self.n, self.up, self.down = 0, [], []

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 65_536)
            grow = lambda b: np.cumprod(np.r_[_ONE, np.full(self.n, b, np.uint64)])
            self.up = [grow(np.uint64(b)) for b in _BASES]
            self.down = [grow(np.uint64(pow(b, -1, 2**64))) for b in _BASES]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, w: int, best: np.ufunc, pad: int) -> np.ndarray:
    """best over each window of w values."""
    n = len(x)
    y = np.full(-(-n // w) * w, pad, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    forth = best.accumulate(y, axis=1).ravel()
    back = best.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], forth[w - 1 : n])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _words_within(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that lie in [start, end), whole or in part."""
    inside = ~_BLANK[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    before = np.concatenate([[0], np.cumsum(first)])
    return before[end] - before[start] + (inside[start] & ~first[start])


def anchors(data: bytes, powers: _Powers, length: int, gram: int, right: int | None = None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of `length` bytes, hashes of their grams, and hashes of their contexts.

    A context has length - gram bytes to the left and `right` (length unless given) to the right. The last bit of its hash tells
    that it has `right` bytes or holds more than `words` words.
    """
    n, right = len(data), right or length
    if n < length:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    powers.upto(n + 1)
    b = np.frombuffer(data, np.uint8)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(t[b] * up[:n])]) for t, up in zip(_TABLES, powers.up, strict=True)]
    m, w = n - gram + 1, length - gram + 1
    grams = _mixed((sums[0][gram:] - sums[0][:m]) * powers.down[0][:m])
    least = _sliding(grams, w, np.minimum, 2**64 - 1)
    most = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum, 0)
    at = np.flatnonzero(most == grams)
    start, end = np.maximum(at - (length - gram), 0), np.minimum(at + right, n)
    body = (sums[1][end] - sums[1][start]) * powers.down[1][start]
    sides = ((at - start) * 4096 + (end - at)).astype(np.uint64)
    full = (end - start >= right) | (_words_within(b, start, end) > words)
    c = _mixed(_mixed(body) ^ sides) & ~_ONE | full.astype(np.uint64)
    return at.astype(np.int32), grams[at].view(np.int64), c.view(np.int64)


def _anchor_rows(length: int, gram: int, right: int, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for pdf in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            found = [anchors(d, powers, length, gram, right, words) for d in data]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "th": pdf["th"], "n_bytes": [len(d) for d in data], "full": [len(d) >= right or len(d.split()) > words for d in data],
                "pos": [x[0] for x in found], "g": [x[1] for x in found], "c": [x[2] for x in found],
            })

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return len(os.path.commonprefix((a[:n], b[:n]))) if n < 64 else _halved(a, b, n)


def _halved(a: bytes, b: bytes, n: int) -> int:
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def scan_intervals(lefts: list[bytes], rights: list[bytes], meet: Callable[[int, int, int, int], None], close: Callable[[int, int, list[int]], None] | None = None) -> None:
    """Stack scan of the common-prefix intervals of the suffixes `rights`; lefts are the reversed texts before them.

    meet(x, y, l, r) is called for members x and y that join at prefix length r with left extension l: for each member of the
    smaller interval and its nearest neighbours, by left context, in the larger. close(l, r, members) is called for each
    interval that is full, with the left extension l that all its members share; as some differ further left and some further
    right, that is a maximal repeat.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    rank = [0] * len(lefts)
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    for k, x in enumerate(by_left):
        rank[x] = k

    def join(one: list[int], two: list[int], r: int) -> list[int]:
        if len(one) < len(two):
            one, two = two, one
        for k in two:
            at = bisect.bisect_left(one, k)
            for other in (one[at - 1] if at else None, one[at] if at < len(one) else None):
                if other is not None:
                    x, y = by_left[k], by_left[other]
                    meet(x, y, _common(lefts[x], lefts[y]), r)
        if len(two) * 8 > len(one):
            return sorted(one + two)
        for k in two:
            bisect.insort(one, k)
        return one

    def pop(r: int) -> None:
        bound = bounds.pop()
        two, one = members.pop(), members.pop()
        members.append(join(one, two, bound))
        if close and not (bounds and bounds[-1] == bound) and r != bound:
            m = members[-1]
            close(_common(lefts[by_left[m[0]]], lefts[by_left[m[-1]]]), bound, [by_left[k] for k in m])

    members, bounds = [], []
    for i, x in enumerate(order):
        if i:
            r = _common(rights[order[i - 1]], rights[x])
            while bounds and bounds[-1] > r:
                pop(r)
            bounds.append(r)
        members.append([rank[x]])
    while bounds:
        pop(-1)


def extents(lefts: list[bytes], rights: list[bytes], length: int = LENGTH, passage: int = PASSAGE, words: int = WORDS) -> list[tuple[int, int, int, int]]:
    """How far the repeated strings of each context reach to the left and right of its anchor: of `length` bytes, then passages; 0, 0 if none repeats."""
    far = [[0, 0, 0, 0] for _ in lefts]

    def meet(x: int, y: int, l: int, r: int) -> None:  # noqa: E741
        if l + r < passage:
            return
        for k in (x, y):
            f = far[k]
            if l + r >= length:
                f[0], f[1] = max(f[0], l), max(f[1], r)
            elif l <= f[2] and r <= f[3]:
                continue
            elif len((lefts[k][:l][::-1] + rights[k][:r]).split()) <= words:
                return
            f[2], f[3] = max(f[2], l), max(f[3], r)

    scan_intervals(lefts, rights, meet)
    return [tuple(f) for f in far]


def _by_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each gram, from batches sorted by gram."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        g = pdf["g"].to_numpy()
        if held and held[-1]["g"].iat[-1] != g[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield pd.concat([*held, pdf.iloc[a:b]], ignore_index=True) if held else pdf.iloc[a:b]
            held = []
        held.append(pdf.iloc[starts[-1] :])
    if held:
        yield pd.concat(held, ignore_index=True)


_FOUND = "g long, c long, l int, r int, pl int, pr int"


def _compare(length: int, passage: int, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["g", "c", "l", "r", "pl", "pr"]
        out, n = [], 0
        for pdf in _by_gram(batches):
            keys = list(dict.fromkeys(zip(pdf["c"], pdf["left"], pdf["right"], strict=True)))
            if len(keys) > 1:
                g = pdf["g"].iloc[0]
                far = extents([k[1] for k in keys], [k[2] for k in keys], length, passage, words)
                out += [(g, k[0], *f) for k, f in zip(keys, far, strict=True) if any(f)]
            n += len(keys)
            if n > 50_000:
                yield pd.DataFrame(out, columns=names)
                out, n = [], 0
        yield pd.DataFrame(out, columns=names).astype("int64")

    return run


def _contexts(length: int, gram: int, right: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for pdf in batches:
            out = []
            for text, want in zip(pdf["text"], pdf["want"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                at, g, c = anchors(data, powers, length, gram, right)
                for k in np.searchsorted(at, np.sort(want)):
                    p = at[k]
                    out.append((g[k], c[k], data[max(0, p - length + gram) : p][::-1], data[p : p + right]))
            yield pd.DataFrame(out, columns=["g", "c", "left", "right"])

    return run


def _passages(data: bytes, least: int, most: int, words: int) -> Iterator[tuple[int, int]]:
    """The shortest passage from each place and the shortest one up to each place: together they cover what all passages cover."""
    b = np.frombuffer(data, np.uint8)
    n, inside = len(b), ~_BLANK[b]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    lasts = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    i, upto = np.arange(n), np.searchsorted(starts, np.arange(n), "right")
    after = upto - inside + words
    ok = after < len(starts)
    end = np.maximum(starts[after[ok]] + 1, i[ok] + least)
    yield from ((x, e) for x, e in zip(i[ok].tolist(), end.tolist(), strict=True) if e <= n and e - x <= most)
    ok = upto > words
    start = np.minimum(lasts[upto[ok] - 1 - words], i[ok] + 1 - least)
    yield from ((x, e) for x, e in zip(start.tolist(), (i[ok] + 1).tolist(), strict=True) if x >= 0 and e - x <= most)


def _strings(length: int, passage: int, words: int):
    """All strings of contexts that count, as 128-bit hashes: w1, w2, and how far they reach before and after the anchor; long tells those of LENGTH bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, c, left, right in zip(pdf["g"], pdf["c"], pdf["left"], pdf["right"], strict=True):
                data, n = left[::-1] + right, len(left)
                spans = [(i, i + length, True) for i in range(min(n, len(data) - length) + 1)]
                spans += [(i, e, False) for i, e in sorted(set(_passages(data, passage, length, words))) if i <= n]
                h = np.frombuffer(b"".join(hashlib.blake2b(data[i:e], digest_size=16).digest() for i, e, _ in spans), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"g": g, "c": c, "w1": h[:, 0], "w2": h[:, 1], "l": [n - i for i, _, _ in spans], "r": [e - n for _, e, _ in spans], "long": [x for _, _, x in spans]})

    return run


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["s"], s["e"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({
            "cn": pdf["cn"], "spans": [[{"s": a, "e": b} for a, b in _merged(x)] for x in pdf["spans"]],
            "n_passage": [sum(b - a for a, b in _merged(x)) for x in pdf["passages"]],
        })


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
            data, runs, at, kept = text.encode("utf-8", "surrogatepass"), [(x["s"], x["e"]) for x in spans], 0, []
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            rest = b"".join(kept) + data[at:]
            rows.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
        yield pd.concat([pdf[["doc_id"]].astype("Int64"), pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"], index=pdf.index), pdf[["n_passage"]]], axis=1)


def _own(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(body.cast("binary"), 256), 1, 32)).alias("th"), body.alias("text"))


def _candidates(own: DataFrame, length: int, gram: int, right: int, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """classes (cn, th, copies, n_bytes, full, first_id) and the anchors of grams that occur at two places (cn, n_bytes, pos, g, c)."""
    long = own.where(F.octet_length("text") >= length)
    schema = "doc_id long, th binary, n_bytes long, full boolean, pos array<int>, g array<long>, c array<long>"
    rows = written(long.mapInPandas(_anchor_rows(length, gram, right, words), schema), "repeat-anchors")
    grouped = rows.groupBy("th").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n_bytes", "full", "pos", "g", "c")))
    classes = written(grouped.withColumn("cn", F.monotonically_increasing_id()), "repeat-classes")
    single = classes.select("cn", "n_bytes", F.explode(F.arrays_zip("pos", "g", "c")).alias("x")).select("cn", "n_bytes", "x.*")
    again = written(single.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1"), "repeat-grams")
    found = join_spread(single, again, ["g"], "_n", ["cn", "pos"])
    return classes.drop("pos", "g", "c"), written(found.select("cn", "n_bytes", "pos", "g", "c"), "repeat-candidates")


def _wanted(own: DataFrame, classes: DataFrame, contexts: DataFrame, several: DataFrame, length: int, gram: int, right: int) -> DataFrame:
    """g, c, left and right of the contexts in grams that have several."""
    want = join_spread(contexts, several, ["g"], "_n", ["c"]).select("rep.*").groupBy("cn").agg(F.collect_list("pos").alias("want"))
    want = written(want.join(classes, "cn").select("th", F.col("first_id").alias("_first"), "want"), "repeat-wanted")
    mine = join_few(own, want, "th", "inner", 4 * F.size("want")).where(F.col("doc_id").eqNullSafe(F.col("_first")))
    return written(mine.select("text", "want").mapInPandas(_contexts(length, gram, right), "g long, c long, left binary, right binary"), "repeat-contexts")


def _grouped(contexts: DataFrame, group: int) -> tuple[DataFrame, DataFrame | None]:
    """Grams of several contexts (g, _n), and those of more than `group` (None without any)."""
    several = written(contexts.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1"), "repeat-several")
    hot = several.where(F.col("_n") > group).select("g")
    return several, None if hot.isEmpty() else hot


def _by_strings(rows: DataFrame, length: int, passage: int, words: int) -> DataFrame:
    """As _compare, by counting all strings of the contexts, whatever their number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.dropDuplicates(["g", "c"]).repartition(n, "g", "c")
    strings = spread.mapInPandas(_strings(length, passage, words), "g long, c long, w1 long, w2 long, l int, r int, long boolean")
    twice = strings.groupBy("g", "w1", "w2", "long").agg(F.count("*").alias("_n")).where("_n > 1").select("g", "w1", "w2", "long")
    reach = lambda c: F.coalesce(F.max(F.when(F.col("long"), F.col(c))), F.lit(0)).alias(c)
    return strings.join(twice, ["g", "w1", "w2", "long"]).groupBy("g", "c").agg(reach("l"), reach("r"), F.max("l").alias("pl"), F.max("r").alias("pr"))


def removal_spans(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, passage: int = PASSAGE, words: int = WORDS
) -> DataFrame:
    """th (16 bytes of a text's SHA-256), whole, spans, n_passage: of each text that repeats anything.

    whole: all of it goes; else spans has the start and end (bytes) of the maximal removed runs, ascending. n_passage: bytes within passages.
    """
    own = _own(docs, text)
    classes, candidates = _candidates(own, passage, gram, length, words)
    contexts = written(candidates.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("cn", "pos")).alias("rep")), "repeat-distinct")
    several, hot = _grouped(contexts, group)
    bytes_ = _wanted(own, classes, contexts, several, passage, gram, length)

    usual = bytes_ if hot is None else bytes_.join(hot, "g", "left_anti")
    found = usual.repartition("g").sortWithinPartitions("g").mapInPandas(_compare(length, passage, words), _FOUND)
    if hot is not None:
        found = found.unionByName(_by_strings(bytes_.join(hot, "g", "left_semi"), length, passage, words))
    found = written(found, "repeat-found")

    # Settled contexts repeat as far as they go; whether that is enough, their own span and the last bit of c tell.
    reach = contexts.join(found, ["g", "c"], "left").where("n > 1 or l is not null")
    settled = F.col("n") > 1
    reach = reach.select("g", "c", "n", settled.alias("settled"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("l", "r", "pl", "pr")))
    reach = written(reach, "repeat-reach")  # cut off from the partitioning by g and c
    far_l, far_r = F.least(F.col("pos"), F.lit(passage - gram)), F.least(F.col("n_bytes") - F.col("pos"), F.lit(length)).cast("int")
    cut = F.col("settled") & (far_l + far_r >= length)
    told = F.col("settled") & (F.col("c").bitwiseAND(F.lit(1)) == 1)
    span = lambda whole, l, r: F.when(whole | (F.col(r) > 0), F.struct((F.col("pos") - F.when(whole, far_l).otherwise(F.col(l))).alias("s"), (F.col("pos") + F.when(whole, far_r).otherwise(F.col(r))).alias("e")))  # noqa: E731, E741
    parts = join_spread(candidates, reach, ["g", "c"], "n", ["cn", "pos"])
    parts = parts.groupBy("cn").agg(F.collect_list(span(cut, "l", "r")).alias("spans"), F.collect_list(span(told, "pl", "pr")).alias("passages"))
    parts = parts.mapInPandas(_runs, "cn long, spans array<struct<s:int,e:int>>, n_passage long")
    whole = F.col("copies") > 1
    of = classes.join(parts, "cn", "left").where("(copies > 1 and full) or n_passage > 0")
    return written(
        of.select(
            "th", (whole & (F.col("n_bytes") >= length)).alias("whole"), F.when(~whole & (F.size("spans") > 0), F.col("spans")).alias("spans"),
            F.when(whole & F.col("full"), F.col("n_bytes")).otherwise(F.coalesce("n_passage", F.lit(0))).alias("n_passage"),
        ), "repeat-spans",
    )


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, passage: int = PASSAGE, words: int = WORDS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage (bytes within passages, those removed included) of every row."""
    with arrow_batches(docs.sparkSession, BATCH):  # all its steps are written
        cut = removal_spans(docs, text, length, gram, group, passage, words)
    own = join_few(_own(docs, text), cut, "th", "left", 8 * F.coalesce(F.size("spans"), F.lit(0)))
    size, told = F.octet_length("text").cast("long"), F.coalesce("n_passage", F.lit(0)).cast("long").alias("n_passage")
    whole = F.coalesce("whole", F.lit(False))
    plain = own.where(F.col("spans").isNull()).select(
        "doc_id", size.alias("n_bytes"), F.when(whole, size).otherwise(F.lit(0).cast("long")).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(F.when(whole, F.lit("")).otherwise(F.col("text")).cast("binary"), 256).alias("kept_sha256"), told,
    )
    partly = own.where(F.col("spans").isNotNull()).select("doc_id", "text", "spans", told)
    return plain.unionByName(partly.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long"))


def _tiles(length: int, gram: int):
    """The contexts of grams with many, for each range of r (from lo, below hi) beside those they share lo bytes to the right and what is needed to the left with."""
    step = max(1, length // 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, c, left, right in zip(pdf["g"], pdf["c"], pdf["left"], pdf["right"], strict=True):
                for lo in range(gram, length + 1, step):
                    least = max(0, length - lo - step + 1)
                    if len(right) >= lo and len(left) >= least:
                        key = hashlib.blake2b(b"%d %d %s" % (g, lo, left[:least][::-1] + right[:lo]), digest_size=8).digest()
                        out.append((int.from_bytes(key, "big", signed=True), g, lo, lo + step, c, left, right))
            yield pd.DataFrame(out, columns=["g", "gram", "lo", "hi", "c", "left", "right"])

    return run


def maximal(lefts: list[bytes], rights: list[bytes], length: int, gram: int, lo: int, hi: int, powers: _Powers) -> list[tuple[int, int, list[int]]]:
    """(l, r, members) of each maximal repeat of `length` bytes or more around the anchor with lo <= r < hi.

    For each interval of left contexts, the intervals of right contexts within it. A repeat is given where the anchor is chosen by
    the repeat's own bytes, so it is an anchor wherever the repeat occurs; each repeat has such an anchor.
    """
    out = []

    def outer(_: int, left: int, inside: list[int]) -> None:
        def close(l: int, r: int, members: list[int]) -> None:  # noqa: E741
            if l == left and l + r >= length and lo <= r < hi:
                k = inside[members[0]]
                if l in anchors(lefts[k][:l][::-1] + rights[k][:r], powers, length, gram)[0]:
                    out.append((l, r, [inside[m] for m in members]))

        scan_intervals([lefts[k] for k in inside], [rights[k] for k in inside], lambda *_: None, close)

    scan_intervals(rights, lefts, lambda *_: None, outer)
    return out


def groups(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Maximal repeats at an anchor, as far as its context goes: g, rep (of the contexts' hashes, ascending), n_bytes, before
    (bytes before the anchor), and all occurrences: the document's text (th) and doc_id, and where the repeat starts.

    Equal texts are one more group, the whole text (g null, rep a hash of it, before 0). The contexts of a gram of more than
    `group` are dealt out by the bytes that repeats within a range of r share on both sides. Repeats that reach beyond a context,
    LENGTH - GRAM bytes to the left and LENGTH to the right of the anchor, are cut there and go on at the next anchor.
    """
    own = _own(docs, text)
    classes, candidates = _candidates(own, length, gram, length)
    contexts = written(candidates.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("cn", "pos", "n_bytes")).alias("rep")), "repeat-distinct")
    several, hot = _grouped(contexts, group)
    bytes_ = _wanted(own, classes, contexts, several, length, gram, length)
    usual = bytes_ if hot is None else bytes_.join(hot, "g", "left_anti")
    dealt = usual.select("g", F.col("g").alias("gram"), F.lit(0).alias("lo"), F.lit(length + 1).alias("hi"), "c", "left", "right")
    if hot is not None:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = bytes_.join(hot, "g", "left_semi").repartition(n, "g", "c")
        dealt = dealt.unionByName(spread.mapInPandas(_tiles(length, gram), "g long, gram long, lo int, hi int, c long, left binary, right binary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for pdf in _by_gram(batches):
            keys = list({(c, a, b): None for c, a, b in zip(pdf["c"], pdf["left"], pdf["right"], strict=True)})
            first = pdf.iloc[0]
            found = maximal([k[1] for k in keys], [k[2] for k in keys], length, gram, first["lo"], first["hi"], powers)
            out = [(first["gram"], min(keys[k][0] for k in m), l + r, l, [keys[k][0] for k in m]) for l, r, m in found]  # noqa: E741
            yield pd.DataFrame(out, columns=["g", "rep", "n_bytes", "before", "cs"])

    found = written(dealt.repartition("g").sortWithinPartitions("g").mapInPandas(run, "g long, rep long, n_bytes int, before int, cs array<long>"), "repeat-groups")
    each = found.select("g", "rep", "n_bytes", "before", F.explode("cs").alias("c"))
    left, right = F.least("rep.pos", F.lit(length - gram)), F.least(F.col("rep.n_bytes") - F.col("rep.pos"), F.lit(length))
    equal = contexts.where("n > 1").select("g", F.col("c").alias("rep"), (left + right).cast("int").alias("n_bytes"), left.cast("int").alias("before"), "c")
    each = each.unionByName(equal.join(each.drop("rep"), ["g", "c", "n_bytes", "before"], "left_anti"))
    placed = each.join(candidates.select("g", "c", "cn", "pos"), ["g", "c"]).join(classes.select("cn", "th"), "cn")
    placed = placed.select("g", "rep", "n_bytes", "before", "th", (F.col("pos") - F.col("before")).alias("start"))
    whole = classes.where("copies > 1").select(F.lit(None).cast("long").alias("g"), F.xxhash64("th").alias("rep"), F.col("n_bytes").cast("int").alias("n_bytes"), F.lit(0).alias("before"), "th", F.lit(0).alias("start"))
    ids = own.where(F.octet_length("text") >= length).select("th", "doc_id")
    return placed.unionByName(whole).join(ids, "th").select("g", "rep", "n_bytes", "before", "th", "start", "doc_id")
