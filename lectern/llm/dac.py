"""Token ids as directly addressable codes (DAC), in shards of documents in ascending doc_id order.

Ids are split into CHUNK-bit levels. Level 0 holds the low bits of every id; a bitmap says which ids go on, and level k+1
holds the next bits of those alone. A rank directory counts the set bits before every block of 512, so the place of an id in
the next level is one lookup and one popcount of at most 512 bits: any id is read without decoding a block.

A shard is one byte string (all numbers little-endian):
  magic "DAC2", u32 levels, u64 documents, u64 ids,
  i64 doc_id of each document, a bitmap of those that are null, u64 place of its first id in the shard, and the number of ids once more,
  and for each level: u64 codes, the codes (1 byte each), the bitmap, u32 set bits before each block of 512.
Shards are rows (shard, documents, ids, payload) of a Parquet table in the shared folder, so any store that Spark writes to
serves, tasks can be repeated and commits are whole. They are not compressed, so a token is read without unpacking anything.
Shard numbers ascend with doc_id.

Texts are dealt out by ranges of doc_id and each task encodes, packs and writes its range, once. Encoding uses the tokenizers
library. White space parts words, and the word pieces of a word don't depend on its neighbours, so Arrow finds the distinct words
of a few megabytes of text, those are encoded, and their ids are gathered for all places. Each worker keeps the ids of the words and
pieces it has met (at most MEMO; then it forgets the older half).

Defined cases: a null text counts as empty (the end id alone); null doc_ids come first; rows that repeat a doc_id are
separate documents in the order of their texts' hashes, so neither kind has to go to one task; a text of any length is read in
pieces; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import join_few, written

CHUNK = 8
BLOCK = 512
END_ID = 1
MEMO = 600_000
#: Ids to a shard: the writer starts another within its partition beyond it.
SHARD_IDS = 4_000_000
#: Documents to a partition of the writer.
SHARD_DOCS = 8_000
#: Characters of text, about, that are encoded at a time.
PIECE = 12_000_000
#: Documents of a shard whose first and last ids the reader looks up directly as well.
LOOKUPS = 16

# ASCII punctuation that may part a word from what surrounds it; an apostrophe may open a contraction.
_PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_BREAK = re.compile(r"[ \t-\r]")


def _pieces(text: str, size: int):
    """The text, cut before blanks where it is longer than `size`."""
    at = 0
    while len(text) - at > size:
        m = _BREAK.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _gathered(pool: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the pool, which falls into runs of the given sizes, in the order `at`; and their sizes."""
    first, n = np.cumsum(size) - size, size[at]
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(pool)) < 2**31 else np.int64
    return pool[np.repeat((first[at] - (upto - n)).astype(kind), n) + np.arange(total, dtype=kind)], n


class WordEncoder:
    """Ids of whole texts, 16 bits each where the vocabulary fits.

    A text falls into words at ASCII blanks, and a word into its core and the ASCII punctuation before and after it; no token spans
    either kind of boundary, nor does normalisation, and case doesn't count. Arrow finds the distinct words and pieces; a memo holds the
    ids of pieces. New pieces of letters alone are encoded many at a time, parted by spaces: each ends with its only word-end token; if
    the counts disagree, one by one.
    """

    def __init__(self, path: str, memo: int = MEMO):
        self.coder, self.most = tokenizer(path), memo
        self.memo: dict[str, bytes] = {"": b""}
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if max(vocabulary.values()) < 65_536 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain = [p for p in pieces if p.isalpha()]
        rest = [p for p in pieces if not p.isalpha()]
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = np.array(self.coder.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, begin = ids.tobytes(), 0
                for p, end in zip(some, (cuts * ids.itemsize).tolist(), strict=True):
                    out[p] = raw[begin:end]
                    begin = end
            else:
                rest += some
        for at in range(0, len(rest), 512):
            some = rest[at : at + 512]
            for p, e in zip(some, self.coder.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[p] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of distinct pieces."""
        memo = self.memo
        found = list(map(memo.get, pieces))
        new = [p for p, f in zip(pieces, found, strict=True) if f is None]
        if not new:
            return found
        have = self._encode(new)
        if len(memo) + len(have) > self.most:
            for p in list(memo)[: len(memo) // 2]:
                del memo[p]
            memo[""] = b""
        if len(memo) + len(have) <= self.most:
            memo.update(have)
        return [have[p] if f is None else f for p, f in zip(pieces, found, strict=True)]

    @staticmethod
    def _parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Distinct pieces, and three of them for each word: what is before its core, the core, and what is after; "" comes first."""
        marked = pc.match_substring(words, "<|")  # the vocabulary's own marks stay whole
        core, rest = pc.utf8_trim(words, _PUNCTUATION), pc.utf8_ltrim(words, _PUNCTUATION)
        ends = [pc.utf8_is_alnum(pc.utf8_slice_codeunits(core, i, j)) for i, j in ((0, 1), (-1, None))]
        shorter = pc.less(pc.binary_length(core), pc.binary_length(words))
        cut = pc.and_(pc.and_(shorter, pc.and_(*ends)), pc.invert(marked)).to_numpy(zero_copy_only=False)
        core = pc.if_else(cut, core, words)
        core = pc.if_else(pc.and_(pc.string_is_ascii(core), pc.invert(marked)), pc.ascii_lower(core), core)
        at = np.flatnonzero(cut)
        some = words.take(at).to_pylist()
        before = (pc.binary_length(words).to_numpy() - pc.binary_length(rest).to_numpy())[at].tolist()
        size = pc.utf8_length(core).to_numpy()[at].tolist()
        leads = pa.array([w[:n] for w, n in zip(some, before, strict=True)], words.type)
        trails = pa.array([w[n + k :] for w, n, k in zip(some, before, size, strict=True)], words.type)
        every = pa.chunked_array([pa.array([""], words.type), core, leads, trails]).combine_chunks().dictionary_encode()
        index, three = every.indices.to_numpy(), np.zeros((len(words), 3), np.int64)
        three[:, 1] = index[1 : 1 + len(words)]
        three[at, 0] = index[1 + len(words) : 1 + len(words) + len(at)]
        three[at, 2] = index[1 + len(words) + len(at) :]
        return every.dictionary, three

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        each = split.flatten().dictionary_encode()
        pieces, three = self._parts(each.dictionary)
        ids = self._known(pieces.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        pool, n = _gathered(np.frombuffer(b"".join(ids), self.dtype), size, three.ravel())
        out, n = _gathered(pool, n.reshape(-1, 3).sum(axis=1), each.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(n)])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return out, np.diff(upto[bounds])

    def __call__(self, texts: list[str | None], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and how many each has."""
        counts, out, held, owner, size = np.zeros(len(texts), np.int64), [], [], [], 0

        def flush() -> None:
            ids, n = self._some(held)
            np.add.at(counts, owner, n)
            out.append(ids)

        for k, text in enumerate(texts):
            for part in _pieces(text or "", piece):
                held.append(part)
                owner.append(k)
                size += len(part)
                if size >= piece:
                    flush()
                    held, owner, size = [], [], 0
        if held:
            flush()
        return np.concatenate(out) if out else np.empty(0, self.dtype), counts


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The worker's own encoder; its memo serves all tasks that the worker runs."""
    return WordEncoder(path)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> bytes:
    """The byte string of a shard; null says which doc_ids are none."""
    null = np.zeros(len(counts), bool) if null is None else null
    starts = np.zeros(len(counts) + 1, "<u8")
    np.cumsum(counts, out=starts[1:])
    levels, rest = [], ids.astype(np.uint32)
    while True:
        code = (rest & ((1 << CHUNK) - 1)).astype(np.uint8)
        rest = rest >> CHUNK
        more = rest > 0
        levels.append((code, more))
        if not more.any():
            break
        rest = rest[more]
    out = [b"DAC2", struct.pack("<IQQ", len(levels), len(counts), len(ids)), doc_ids.astype("<i8").tobytes(), np.packbits(null, bitorder="little").tobytes(), starts.tobytes()]
    for code, more in levels:
        before = np.zeros(len(code) // BLOCK + 1, "<u4")
        before[1:] = np.cumsum(np.add.reduceat(more, np.arange(0, len(code), BLOCK), dtype=np.int64))[: len(before) - 1] if len(code) else []
        out += [struct.pack("<Q", len(code)), code.tobytes(), np.packbits(more, bitorder="little").tobytes(), before.tobytes()]
    return b"".join(out)


class Shard:
    """Random and sequential access to a shard's ids."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC2":
            raise ValueError("not a DAC shard")
        n_levels, self.n_docs, self.n_ids = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.null = np.unpackbits(np.frombuffer(data, np.uint8, -(-self.n_docs // 8), at), bitorder="little")[: self.n_docs].astype(bool)
        at += -(-self.n_docs // 8)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            code = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += -(-n // 8)
            before = np.frombuffer(data, "<u4", n // BLOCK + 1, at)
            at += 4 * (n // BLOCK + 1)
            self.levels.append((code, bits, before))

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (code, bits, before) in enumerate(self.levels):
            value |= int(code[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            part = np.unpackbits(bits[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(before[i // BLOCK]) + int(part.sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n_ids, "<u4")
        at = np.arange(self.n_ids)
        for k, (code, bits, _) in enumerate(self.levels):
            out[at] |= code.astype(np.uint32) << np.uint32(CHUNK * k)
            at = at[np.unpackbits(bits, bitorder="little")[: len(code)].astype(bool)]
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _shards(path: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, coder = TaskContext.get().partitionId(), 0, encoder(path)
        doc_ids: list[np.ndarray] = []
        null: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            data = pack(np.concatenate(doc_ids), np.concatenate(counts), np.concatenate(ids), np.concatenate(null))
            out = [[(part << 32) + number], [sum(map(len, doc_ids))], [size], [data]]
            number, size = number + 1, 0
            doc_ids.clear(), null.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["shard", "documents", "n_ids", "payload"])

        for batch in batches:
            none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            keys = batch.column("doc_id").fill_null(0).to_numpy()
            texts = batch.column("text")
            length = np.cumsum(np.concatenate([[0], pc.binary_length(texts.fill_null("")).to_numpy()]))
            at = 0
            while at < len(keys):  # a few megabytes of text at a time
                stop = max(at + 1, int(np.searchsorted(length, length[at] + PIECE, "right")) - 1)
                found, n = coder(texts.slice(at, stop - at).to_pylist())
                # the end id goes after each document's own
                counts.append(n + 1)
                ids.append(np.insert(found, np.cumsum(n), end_id))
                doc_ids.append(keys[at:stop])
                null.append(none[at:stop])
                size += len(ids[-1])
                if size >= limit:
                    yield close()
                at = stop
        if doc_ids:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str | None = None, text: str = "text", end_id: int = END_ID, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes docs, writes the shards, and returns their table (shard, documents, n_ids, payload)."""
    path = path or default_path()
    n = max(1, -(-docs.count() // shard_docs))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = own.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(_shards(path, end_id, shard_ids), "shard long, documents long, n_ids long, payload binary"), "dac", "none")


def _starts(shards: DataFrame, part: int = 1000) -> DataFrame:
    """shard and before, the number of ids in all shards before it: sums within groups of `part` partitions, then over the groups."""
    own = written(shards.select("shard", "n_ids", F.floor(F.shiftright("shard", 32) / part).alias("grp")), "dac-sizes")
    groups = own.groupBy("grp").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))  # a row for each group
    within = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("grp", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    return written(own.join(groups, "grp").select("shard", (F.col("base") + F.col("inner")).alias("before")), "dac-starts")


def read_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' bytes.

    The first and last ids of some documents of each shard are looked up by random access too, and must be those read in sequence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data, first in zip(pdf["payload"], pdf["before"], strict=True):
                shard = Shard(data)
                ids, ends = shard.ids(), shard.starts
                for k in range(0, shard.n_docs, max(1, shard.n_docs // LOOKUPS)):
                    for i in (int(ends[k]), int(ends[k + 1]) - 1):
                        if shard[i] != ids[i]:
                            raise ValueError(f"id {i} of a shard is {shard[i]} by its place and {ids[i]} in sequence")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(shard.doc_ids.astype(np.int64), shard.null),
                    "start": ends[:-1] + int(first), "n_tokens": np.diff(ends), "ids_crc32": crc,
                })

    placed = join_few(shards, _starts(shards), "shard", "inner")
    return placed.select("payload", "before").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
