"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is cut into pieces at safe boundaries once it is longer than PIECE characters: between an ASCII letter or digit and a
following space or newline. No match of the pre-splitting pattern can span such a place, nor look past it, so the pieces' ids
joined are the ids of the whole text. A stretch without a safe boundary stays whole. Decoding joins the raw bytes of the ids;
it never goes through text, so ids that split a character decode exactly.

Defined cases: null counts as the empty text (no ids); equal rows give equal results; an empty table gives an empty result;
other columns are ignored (encode) or kept (append).
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 65_536
_SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Consecutive parts of text that can be encoded one by one."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size - 1)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode(text: str, path: str, pattern: str, size: int = PIECE) -> np.ndarray:
    coder = encoding(path, pattern)
    if len(text) <= size:
        return np.array(coder.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(coder.encode_ordinary(p), dtype="<u4") for p in pieces(text, size)])


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(ids.tolist())


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with all columns plus a struct `bpe`: ids (binary, little-endian unsigned 32-bit) and decoded (binary)."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    @F.pandas_udf("ids binary, decoded binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        ids = [encode(t or "", path, pattern) for t in texts]
        return pd.DataFrame({"ids": [x.tobytes() for x in ids], "decoded": [decode(x, path, pattern) for x in ids]})

    return docs.withColumn("bpe", run(F.col(text)))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and bytes stay in the Python worker."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            ids = encode(t or "", path, pattern)
            back = decode(ids, path, pattern)
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run(F.col(text)).alias("r")).select("doc_id", "r.*")
