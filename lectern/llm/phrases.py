"""Phrase collocations: frequent phrases of two to five words for each language, scored by their weakest cut.

Texts are lower-cased (A-Z), split at .,;:!? and line ends into pieces and those into words (runs without space and tab); phrases never
leave a piece. Words and phrases are numbered, and a phrase of k words is the pair (number of its first k - 1 words, number of
its last k - 1 words), packed in 64 bits: exact, whatever the words. So a text becomes an array of numbers at each length, with -1
where nothing frequent starts, and shrinks with the length.

For each length, candidates are the pairs of neighbouring frequent phrases (Apriori-safe: a phrase is never more frequent than its
parts) that occur `least` times. Mappers first count pairs by the bucket of their hash, in byte arrays that stop at `least`; the tree's
sum of these tells which pairs can't be frequent, and only others are summed by key. Candidates get a minimal perfect hash (levels
of bit arrays with ranks) that stores each slot's key, so that a look-up of any other pair is told apart exactly. Mappers read the
arrays once more: they look up all pairs, bincount slots into a numpy array, and write the arrays of the next length; the
counts are summed in a tree. Words have such a hash as well, which stores the words. Cuts are joined by slot: every prefix
and suffix of a phrase is a phrase that was counted before.

Memory: a hash holds about SLOTS keys and WORD_BYTES of words at most; more are dealt to as many hashes, one pass over the arrays for
each, so neither driver nor task ever holds more. There is a bucket for eight pairs, and 2^MOST_BITS at most: beyond that, fewer pairs
are told apart early and more are summed by key, with the same result. Keys are summed in parts by their hash, in a tree as well.

Defined cases: a null text is empty; a null language is `und`; equal rows count each; ties in score go to the shorter first part; an
empty table, or one without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches, written

LEAST, LONGEST, FIRST = 100, 5, 2000
UNKNOWN = "und"
#: Candidates of one hash (8 MB of keys, and 8 MB of counters in each task), bytes of its words, and bits of a bucket's number.
SLOTS, WORD_BYTES, MOST_BITS = 1 << 20, 64 << 20, 26
#: Documents a batch, keys that a mapper gathers before it sums them, counters in a row, and rows that a task of the tree sums.
ROWS, GATHER, CHUNK, FAN = 1000, 1 << 19, 1 << 16, 64
#: Bytes of text, about, and words that a mapper works on at a time.
PIECE, HASHED = 2 << 20, 1 << 16

_UPPER, _ENDS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?\x0b\x0c\r"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SlotHash:
    """Minimal perfect hash of distinct 64-bit keys onto 0..n-1, with the key of each slot."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, before = keys.astype(np.uint64), 0
        while len(rest):
            size = -(-max(1, len(rest) * 2) // 64) * 64
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((size, bits, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            rest = rest[~alone[at]]
        self.keys = np.zeros(len(keys), np.int64)
        self.keys[self._slots(keys)] = keys

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(keys, level) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, rest, left = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys.astype(np.uint64)
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._place(left, level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[here]] = ranks[at >> 6][here] + below[here]
            rest, left = rest[~here], left[~here]
            if not len(rest):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that aren't stored."""
        slots = self._slots(keys)
        if len(self.keys):
            slots[self.keys[slots] != keys] = -1
        return slots


class WordTable:
    """Numbers of words by language: a minimal perfect hash of their hashes, with the word and language of each slot."""

    def __init__(self, langs: list[str], words: list[str], base: int):
        self.base, self.seed = base, 0
        while len(np.unique(keys := self._keys(langs, words))) < len(keys):
            self.seed += 1
        self.hash = SlotHash(keys)
        order = np.argsort(self.hash.find(keys))
        self.words = pa.array(words, pa.large_string()).take(pa.array(order))
        self.langs = pa.array(langs, pa.large_string()).take(pa.array(order)).dictionary_encode()
        self.order = order

    def _keys(self, langs: list[str], words: list[str]) -> np.ndarray:
        one = lambda x: np.concatenate([np.zeros(0, np.uint64), *(pd.util.hash_array(np.array(x[i : i + HASHED], dtype=object), categorize=False) for i in range(0, len(x), HASHED))])
        return (_mixed(one(words), self.seed) ^ _mixed(one(langs), self.seed + 7)).view(np.int64)

    def find(self, lang: str, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for others."""
        at = pc.index_in(pa.scalar(lang, pa.large_string()), self.langs.dictionary).as_py()
        if at is None or not len(words):
            return np.full(len(words), -1, "<i4")
        parts = (words.slice(i, HASHED).to_pylist() for i in range(0, len(words), HASHED))
        slots = self.hash.find(np.concatenate([self._keys([lang], part) for part in parts]))
        some = np.flatnonzero(slots >= 0)
        same = pc.equal(self.words.take(pa.array(slots[some])), words.cast(pa.large_string()).take(pa.array(some))).to_numpy(zero_copy_only=False)
        same &= self.langs.indices.to_numpy()[slots[some]] == at
        out = np.full(len(words), -1, "<i4")
        out[some[same]] = self.base + slots[some[same]]
        return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE bytes of text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield b.slice(at, stop - at)
            at = stop


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece and language: its different words, their counts, and the texts as places in that list, -1 at the ends of pieces."""
    for b in _pieces(batches):
        langs = b.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield _coded_texts(lang, b.column("text").filter(pc.equal(langs.indices, k)))
        pa.default_memory_pool().release_unused()


def _coded_texts(lang: str, texts: pa.Array) -> pa.RecordBatch:
    end, space = (pa.scalar(x, pa.large_string()) for x in ("\n", " "))
    spaced = pc.binary_join_element_wise(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n "), end, space)
    words = pc.split_pattern(spaced, " ").flatten().dictionary_encode()
    values, codes = words.dictionary, words.indices.to_numpy()
    real = pc.invert(pc.is_in(values, pa.array(["", "\n"], values.type))).to_numpy(zero_copy_only=False)
    place = np.where(real, np.cumsum(real) - 1, -1).astype("<i4")
    blank = pc.equal(values, "").to_numpy(zero_copy_only=False)
    coded = place[codes[~blank[codes]]]
    n = int(real.sum())
    counts = np.bincount(coded[coded >= 0], minlength=n)
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x)
    return pa.record_batch([pa.array([lang]), whole(values.filter(pa.array(real)).cast(pa.string())), whole(pa.array(counts, pa.int64())), pa.array([coded.tobytes()], pa.binary())], ["lang", "words", "counts", "codes"])


def _dense(slots: np.ndarray) -> np.ndarray:
    """slots with each run of -1 as one."""
    kept = slots >= 0
    return slots[kept | np.concatenate([[False], kept[:-1]])]


def _state_row(slots: np.ndarray) -> list[pa.Array]:
    """The columns of an array of numbers: its bytes, and how many pairs of neighbours it holds."""
    slots = _dense(slots)
    return [pa.array([slots.astype("<i4").tobytes()], pa.binary()), pa.array([len(_pairs(slots)[0])], pa.int64())]


def _words_numbered(shared, first: bool, last: bool):
    """Numbers of the words that this table holds; at last, the texts as arrays of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: WordTable = shared.value
        for b in batches:
            for i in range(b.num_rows):
                lang, words = b.column("lang")[i].as_py(), b.column("words")[i].values
                ids = table.find(lang, words)
                if not first:
                    ids = np.maximum(ids, b.column("ids")[i].values.to_numpy())
                if last:
                    place = np.append(ids, -1)  # the last stands for ends of pieces
                    yield pa.record_batch(_state_row(place[np.frombuffer(b.column("codes")[i].as_buffer(), "<i4")]), ["slots", "pairs"])
                else:
                    part = b.slice(i, 1)
                    yield pa.record_batch([part.column("lang"), part.column("words"), part.column("codes"), pa.array([ids], pa.list_(pa.int32()))], ["lang", "words", "codes", "ids"])

    return run


def _pairs(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two frequent phrases start side by side, and the keys of the pairs."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    return at, slots[at].astype(np.int64) << 32 | slots[at + 1]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The keys of all pairs, GATHER or more at a time."""
    gathered, size = [], 0
    for b in batches:
        for slots in b.column("slots"):
            gathered.append(_pairs(np.frombuffer(slots.as_buffer(), "<i4"))[1])
            size += len(gathered[-1])
            if size >= GATHER:
                yield np.concatenate(gathered)
                gathered, size = [], 0
    if size:
        yield np.concatenate(gathered)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(keys, 77) >> np.uint64(64 - bits)).astype(np.int64)


def _bucketed(bits: int, least: int):
    """This task's counts of pairs by bucket, up to `least`, in chunks of bytes (or pairs of bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, _small(least))
        for keys in _gathered(batches):
            at, n = np.unique(_bucket(keys, bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, least)
        task = TaskContext.get().partitionId()
        for at in range(0, len(counts), CHUNK):
            part = counts[at : at + CHUNK]
            if part.any():
                yield pa.record_batch([pa.array([at // CHUNK], pa.int32()), pa.array([task], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["chunk", "task", "counts"])

    return run


def _small(least: int):
    return np.uint8 if least < 256 else np.uint32


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def _observed(shared, bits: int, part_bits: int):
    """Keys and counts of this task's pairs whose bucket may be frequent, in parts by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, keys, counts = TaskContext.get().partitionId(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def parts():
            of = (_mixed(keys, 78) >> np.uint64(64 - part_bits)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
            for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                mine = order[a:b]
                yield pa.record_batch(
                    [pa.array([of[mine[0]]], pa.int32()), pa.array([task], pa.int64()), pa.array([keys[mine].tobytes()], pa.binary()), pa.array([counts[mine].tobytes()], pa.binary())],
                    ["part", "task", "keys", "counts"],
                )

        for found in _gathered(batches):
            at = _bucket(found, bits)
            found, n = np.unique(found[shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1], return_counts=True)
            keys, counts = _added([keys, found], [counts, n])
            if len(keys) >= GATHER:
                yield from parts()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield from parts()

    return run


def _candidates(parts: DataFrame, least: int) -> DataFrame:
    """The keys whose counts reach `least`: tasks' parts merged in a tree."""

    def merged(key, group):
        keys, counts = _added(*([np.frombuffer(x.as_buffer(), np.int64) for x in group.column(c)] for c in ("keys", "counts")))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(keys.as_buffer(), np.int64)[np.frombuffer(counts.as_buffer(), np.int64) >= least])], ["key"])

    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("part", "task").applyInArrow(merged, "part int, task long, keys binary, counts binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return parts.mapInArrow(frequent, "key long")


def _counted(shared, base: int, first: bool, last: bool):
    """Rows of two kinds: the arrays with the next length's slots (from base), and this task's counters in chunks.

    After the last of a length's hashes, the arrays are those of the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: SlotHash = shared.value
        counts = np.zeros(len(table), np.int64)
        names = ["slots", "pairs", "found", "chunk", "task", "counts"]
        types = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
        row = lambda *values: pa.record_batch([v if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(values, types, strict=True)], names)
        for b in batches:
            for i, value in enumerate(b.column("slots")):
                slots = np.frombuffer(value.as_buffer(), "<i4")
                found = np.full(len(slots), -1, "<i4") if first else np.frombuffer(b.column("found")[i].as_buffer(), "<i4").copy()
                at, keys = _pairs(slots)
                mine = table.find(keys)
                known = mine >= 0
                counts += np.bincount(mine[known], minlength=len(table))
                found[at[known]] = base + mine[known]
                if not last:
                    yield row(slots.tobytes(), len(at), found.tobytes(), None, None, None)
                elif (found >= 0).any():
                    yield row(*_state_row(found), None, None, None, None)
        if counts.any():
            task = TaskContext.get().partitionId()
            for at in range(0, len(counts), CHUNK):
                yield row(None, None, None, at // CHUNK, task, zlib.compress(counts[at : at + CHUNK].tobytes(), 1))

    return run


def _tree_sum(parts: DataFrame, kind, most: int | None = None) -> DataFrame:
    """chunk and counts: the sum of all tasks' counters (up to `most`); each task of the tree adds FAN rows of a chunk at most."""

    def added(key, group):
        total = np.zeros(0, np.int64)
        for x in group.column("counts"):
            own = np.frombuffer(zlib.decompress(x.as_buffer()), kind)
            total = own.astype(np.int64) if not len(total) else total + own
        total = (total if most is None else np.minimum(total, most)).astype(kind)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("chunk", "task").applyInArrow(added, "chunk int, task long, counts binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return parts.select("chunk", "counts")


def _buckets(state: DataFrame, k: int, least: int) -> tuple[np.ndarray, int, int]:
    """A bit for each bucket (about one for eight pairs), set where its pairs may be frequent, and the bits of a bucket's and of a part's number."""
    pairs = state.agg(F.sum("pairs")).first()[0] or 0
    bits = min(MOST_BITS, max(10, int(pairs).bit_length() - 3))
    own = written(state.mapInArrow(_bucketed(bits, least), "chunk int, task long, counts binary"), f"phrase-buckets-{k}")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.packbits(np.frombuffer(zlib.decompress(x.as_buffer()), _small(least)) >= least, bitorder="little").tobytes() for x in b.column("counts")]
            yield pa.record_batch([b.column("chunk"), pa.array(sets, pa.binary())], ["chunk", "bits"])

    out, step = np.zeros(1 << (bits - 3), np.uint8), min(CHUNK, 1 << bits) // 8
    for chunk, sets in _tree_sum(own, _small(least), least).mapInArrow(frequent, "chunk int, bits binary").collect():  # 8 MB at most
        out[chunk * step : (chunk + 1) * step] = np.frombuffer(sets, np.uint8)
    return out, bits, min(14, max(4, int(pairs).bit_length() - 20))


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length the table of frequent phrases:
    id, prefix, suffix (ids of the length before), lang, phrase, last (word), a (count), pre and suf (counts of its first and last 1.. words).
    """
    spark = docs.sparkSession
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER + _ENDS + "\t", _UPPER.lower() + "\n" * len(_ENDS) + " ")
    own = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), plain.alias("text"))
    with arrow_batches(spark, ROWS):
        texts = written(own.mapInArrow(_coded, "lang string, words array<string>, counts array<long>, codes binary"), "phrase-texts")
    totals = texts.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    seen = texts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    frequent = written(seen.groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("counts").alias("a")).where(F.col("a") >= least), "phrase-words")
    with arrow_batches(spark, 4):
        words, state = _number_words(texts.select("lang", "words", "codes"), frequent)
        levels = [words]
        for k in range(2, longest + 1):
            found, state = _next_length(state, k, least, last=k == longest)
            if found is None:
                break
            levels.append(written(_with_cuts(found, levels[-1]), f"phrase-table-{k}"))
    return totals, levels


def _number_words(texts: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of frequent words, and the texts as arrays of their numbers."""
    spark = texts.sparkSession
    total, size = frequent.agg(F.count("*"), F.sum(F.octet_length("phrase") + F.octet_length("lang"))).first()
    rounds, found, base = max(1, -(-total // SLOTS), -(-(size or 0) // WORD_BYTES)), [], 0
    turn = F.pmod(F.xxhash64("lang", "phrase"), F.lit(rounds))
    for i in range(rounds):
        rows = frequent.where(turn == i).toArrow()  # about SLOTS words or WORD_BYTES
        table = WordTable(rows.column("lang").to_pylist(), rows.column("phrase").to_pylist(), base)
        shared = spark.sparkContext.broadcast(table)
        last = i == rounds - 1
        step = texts.mapInArrow(_words_numbered(shared, i == 0, last), "slots binary, pairs long" if last else "lang string, words array<string>, codes binary, ids array<int>")
        texts = written(step, f"phrase-1-{i}")
        shared.unpersist()
        ids = np.arange(base, base + len(rows))
        found.append(spark.createDataFrame(pa.table({"id": ids, **{c: rows.column(c).take(pa.array(table.order)) for c in ("lang", "phrase", "a")}})))
        base += len(rows)
    none = F.array().cast("array<long>")
    words = [written(df.select("id", F.lit(-1).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("suffix"), "lang", "phrase", F.col("phrase").alias("last"), "a", none.alias("pre"), none.alias("suf")), "phrase-table-1") for df in found]
    return functools.reduce(DataFrame.unionByName, words), texts


def _next_length(state: DataFrame, k: int, least: int, last: bool) -> tuple[DataFrame | None, DataFrame]:
    """(id, prefix, suffix, a) of the frequent phrases of k words, and the texts as arrays of their ids."""
    spark = state.sparkSession
    sets, bits, part_bits = _buckets(state, k, least)
    shared = spark.sparkContext.broadcast(sets)
    seen = written(state.mapInArrow(_observed(shared, bits, part_bits), "part int, task long, keys binary, counts binary"), f"phrase-seen-{k}")
    candidates = written(_candidates(seen, least), f"phrase-keys-{k}")
    shared.unpersist()
    total = candidates.count()
    rounds, found, base = -(-total // SLOTS), None, 0
    turn = F.pmod(F.xxhash64("key"), F.lit(max(1, rounds)))
    for i in range(rounds):
        keys = np.sort(candidates.where(turn == i).toArrow().column("key").to_numpy())  # about SLOTS
        table = SlotHash(keys)
        shared = spark.sparkContext.broadcast(table)
        step = state.mapInArrow(_counted(shared, base, i == 0, i == rounds - 1), "slots binary, pairs long, found binary, chunk int, task long, counts binary")
        passed = written(step, f"phrase-{k}-{i}")
        shared.unpersist()
        counts = np.zeros(len(table), np.int64)
        for chunk, own in _tree_sum(passed.where("counts is not null").select("chunk", "task", "counts"), np.int64).collect():  # a number for each key
            counts[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(own), np.int64)
        ids = np.arange(base, base + len(table))
        part = spark.createDataFrame(pa.table({"id": ids, "prefix": table.keys >> 32, "suffix": table.keys & 0xFFFFFFFF, "a": counts}))
        part = written(part.where(F.col("a") >= least), f"phrase-slots-{k}")
        found = part if found is None else found.unionByName(part)
        state, base = passed.where("slots is not null").select("slots", "pairs", "found"), base + len(table)
    return found, state


def _with_cuts(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """found with language, words and the counts of all its prefixes and suffixes, read by slot."""
    p = shorter.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("_phrase"), F.array_append("pre", F.col("a")).alias("pre"))
    s = shorter.select(F.col("id").alias("suffix"), "last", F.array_append("suf", F.col("a")).alias("suf"))
    both = found.join(p, "prefix").join(s, "suffix")
    return both.select("id", "prefix", "suffix", "lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "a", "pre", "suf")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits, exact for counts up to 10^17."""
    top = (a.cast("decimal(17,0)") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * n.cast("decimal(17,0)")
    return F.call_function("div", top, l.cast("decimal(18,0)") * r.cast("decimal(18,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `first` phrases."""
    totals, levels = count_phrases(docs, least, longest, text, lang)
    kept = None
    for k, own in enumerate(levels[1:], 2):
        if k < len(levels):  # a phrase lies in a longer one as often as in one of k + 1 words
            longer = levels[k]
            around = longer.select(F.col("prefix").alias("id"), F.col("a").alias("around")).unionByName(longer.select(F.col("suffix").alias("id"), F.col("a").alias("around")))
            own = own.join(around.groupBy("id").agg(F.max("around").alias("around")), "id", "left").where(F.coalesce(F.col("around") < F.col("a"), F.lit(True)))
        part = own.select("lang", "phrase", "a", "pre", "suf")
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    size = F.size("pre")
    cuts = F.transform(F.sequence(F.lit(1), size), lambda c: F.struct(
        score(F.col("a"), F.col("n"), F.get("pre", c - 1), F.get("suf", size - c)).alias("score"), c.alias("cut"), F.get("pre", c - 1).alias("l"), F.get("suf", size - c).alias("r"),
    ))
    judged = kept.join(totals, "lang").withColumn("_cut", F.array_min(cuts))
    order = Window.partitionBy("lang").orderBy(F.col("_cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = judged.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
