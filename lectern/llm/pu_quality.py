"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled 1; everything else that is learned from is unlabelled text, whatever its label. A small network over
counts of a text's form (shares of character classes and marks, words, lines, repeats) minimises the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),        l(z) = log(1 + exp(-z)),

stepping back along the second part where it falls below zero (told by its running mean over batches, which a single batch would tell
too often). The class prior is estimated from positives and unlabelled texts alone: a
first classifier tells the two apart on one half, and on the other half the prior is the least ratio of the shares of unlabelled and of
positive texts above a threshold, with a margin for the halves' sizes; both ways round are averaged. The score is the network's estimate of the
chance of label 1.

Learned from: a sample of at most about SAMPLE_POSITIVE positives and SAMPLE_UNLABELLED unlabelled texts, taken by a hash of id and text
at a rate that gives so many (all, where there are fewer), equal rows once; documented bounds, so what reaches the driver is bounded. Only
rows of the learning folds (crc32 of the id as text mod 5 is not 0) are learned from, labels and texts alike; id, language and source
are never features. All documents are scored, whole.

Defined cases: a null text is empty and is scored as such; documents with a null id are scored and never learned from; a document
counts as positive if none of its labels is other than 1; without positives all scores are 0.5; equal texts have equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches

SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 40_000, 80_000
THRESHOLD = 0.3
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 1500, 2048, 0.01, 1e-5
#: Rows and characters that features are counted for at a time.
ROWS, CHARS = 512, 2_000_000
SLICE = 128

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = ("upper", "lower", "letter", "digit", "blank", "ascii", "control")


@cache
def _classes() -> np.ndarray:
    """Bits of each code point's classes, in the order of _CLASSES."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        out[c] = x.isupper() | x.islower() << 1 | x.isalpha() << 2 | x.isdigit() << 3 | (x in " \t\n\x0b\x0c\r") << 4 | (c < 128) << 5 | (c < 32 or c == 127) << 6
    return out


def _groups(owner: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner: different codes, occurrences of the commonest, and occurrences of codes that occur twice or more."""
    _, at, count = np.unique(owner.astype(np.int64) << 32 | codes, return_index=True, return_counts=True)
    of, most = owner[at], np.zeros(n)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=n), most, np.bincount(of, np.where(count > 1, count, 0), n)


def _parts(texts: pa.Array, n: int, split) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Owners, codes and different values of the parts that split gives, empty ones left out."""
    lists = split(texts)
    owner, flat = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy()), lists.flatten()
    coded = flat.dictionary_encode()
    codes, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    some = ~(pc.equal(values, "").to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, bool))[codes]
    return owner[some], codes[some].astype(np.int64), values


def _chunk_features(texts: list[str]) -> np.ndarray:
    n = len(texts)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(n), length)
    bits, chars = _classes()[code], np.maximum(1, length)
    classes = [np.bincount(owner, bits >> k & 1, n) / chars for k in range(len(_CLASSES))]
    marked = (code < 128) & ~np.isin(bits & 0b1011100, (4, 8, 16, 64))  # ASCII, no letter, digit, blank or control
    marks = np.zeros((n, 128))
    np.add.at(marks, (owner[marked], code[marked]), 1)
    table = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.large_string())

    words, word, values = _parts(table, n, pc.ascii_split_whitespace)
    n_words = np.bincount(words, minlength=n)
    some = np.maximum(1, n_words)
    flag = lambda x: np.bincount(words, x.to_numpy(zero_copy_only=False).astype(float)[word], n) / some if len(values) else np.zeros(n)
    kinds, most, again = _groups(words, word, n)
    same = words[1:][(words[1:] == words[:-1]) & (word[1:] == word[:-1])]
    if len(word) > 2:
        gram = np.unique(word[:-2] * 1_000_003 ^ word[1:-1] * 8_191 ^ word[2:], return_inverse=True)[1]
        inside = words[2:] == words[:-2]
        g_kinds, g_most, g_again = _groups(words[2:][inside], gram[inside], n)
        grams = np.maximum(1, np.bincount(words[2:][inside], minlength=n))
    else:
        g_kinds = g_most = g_again = np.zeros(n)
        grams = np.ones(n)
    lines, line, _ = _parts(table, n, lambda x: pc.split_pattern(x, "\n"))
    n_lines = np.maximum(1, np.bincount(lines, minlength=n))
    l_kinds, _, l_again = _groups(lines, line, n)
    sizes = pc.utf8_length(values).cast(pa.float64()) if len(values) else values
    columns = [
        np.log1p(length), np.log1p(n_words), np.log1p(n_lines), chars / n_lines / 100.0, *classes,
        flag(sizes) / 10.0 if len(values) else np.zeros(n), kinds / some, kinds / np.sqrt(some), most / some, again / some, np.bincount(same, minlength=n) / some,
        g_kinds / grams, g_most / grams, g_again / grams, l_kinds / n_lines, l_again / n_lines,
        flag(pc.utf8_is_upper(values)), flag(pc.utf8_is_title(values)), flag(pc.match_substring_regex(values, r"[\pL\pN]$")),
        flag(pc.match_substring_regex(values, r"[.,;:!?]$")), flag(pc.match_substring_regex(values, r"\pL")), flag(pc.match_substring_regex(values, r"[^\pL\pN]{2}$")),
    ]
    return np.column_stack([*columns, np.sqrt(marks[:, [ord(c) for c in _MARKS]] / some[:, None])]).astype(np.float32)


def features(texts: list[str]) -> np.ndarray:
    """One row of features for each text; texts are taken in chunks, whole."""
    out, chunk, size = [], [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHARS:
            out.append(_chunk_features(chunk))
            chunk, size = [], 0
    if chunk or not out:
        out.append(_chunk_features(chunk) if chunk else np.zeros((0, _chunk_features([""]).shape[1]), np.float32))
    return np.concatenate(out)


def _sliced(x: np.ndarray) -> np.ndarray:
    """Rows in slices, whose products are too small for BLAS to start threads, which would wait for cores that other work holds."""
    n = SLICE if len(x) % SLICE == 0 else len(x)
    return x.reshape(-1, n, *x.shape[1:])


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        start = (rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1))
        self.p = [x.astype(np.float32) for x in start]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return (np.tanh(_sliced(x) @ w1 + b1) @ w2).reshape(-1) + b2[0]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float = RATE) -> None:
        """One Adam step for a loss with this slope at each row's logit."""
        w1, b1, w2, _ = self.p
        slope = slope.astype(np.float32)
        xs, s = _sliced(x), _sliced(slope)
        h = np.tanh(xs @ w1 + b1)
        back = s[..., None] * w2 * (1 - h * h)
        grads = [(xs.transpose(0, 2, 1) @ back).sum(0) + DECAY * w1, back.sum((0, 1)), (s[..., None] * h).sum((0, 1)) + DECAY * w2, slope.sum(keepdims=True)]
        self.t += 1
        for p, g, m, v in zip(self.p, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In double precision and rounded, so that a text's score doesn't hang on the rows beside it."""
        w1, b1, w2, b2 = (p.astype(np.float64) for p in self.p)
        return _sigmoid(np.tanh(self.prepared(x).astype(np.float64) @ w1 + b1) @ w2 + b2[0]).round(9)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def non_negative_risk(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 11) -> None:
    """Fits net to prepared rows by the non-negative unbiased risk."""
    rng = np.random.default_rng(seed)
    running = 0.0
    for i in range(steps):
        p, u = positive[rng.integers(0, len(positive), BATCH)], unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        x = np.concatenate([p, u])
        z = net.logits(x)
        zp, zu = z[:BATCH], z[BATCH:]
        negative = _loss(-zu).mean() - prior * _loss(-zp).mean()
        running = negative if not i else 0.95 * running + 0.05 * negative
        slope_p, slope_u = -prior * _sigmoid(zp) / BATCH, _sigmoid(zu) / BATCH  # of the second part
        of_positive = -prior * _sigmoid(-zp) / BATCH
        slope = [of_positive + slope_p, slope_u] if running >= 0 else [-slope_p, -slope_u]
        net.step(x, np.concatenate(slope), RATE * (1 - i / steps))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int = 5) -> float:
    """Share of positives among unlabelled rows: least ratio of shares above a threshold of a classifier that tells both apart."""
    rng = np.random.default_rng(seed)
    (p, q), (u, v) = (np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled))
    if not len(q) or not len(v):
        return 0.5
    found = [_prior_of(Network(mean, scale), rng, *parts) for parts in ((p, u, q, v), (q, v, p, u))]
    return float(np.clip(np.mean(found), 0.05, 0.98))


def _prior_of(net: Network, rng: np.random.Generator, fit_p: np.ndarray, fit_u: np.ndarray, own_p: np.ndarray, own_u: np.ndarray) -> float:
    y = np.repeat([1.0, 0.0], BATCH)
    for _ in range(STEPS // 5):
        x = np.concatenate([fit_p[rng.integers(0, len(fit_p), BATCH)], fit_u[rng.integers(0, len(fit_u), BATCH)]])
        net.step(x, (_sigmoid(net.logits(x)) - y) / len(x))
    zp, zu = np.sort(net.logits(own_p)), np.sort(net.logits(own_u))
    at = np.unique(zp)
    share_p, share_u = 1 - np.searchsorted(zp, at) / len(zp), 1 - np.searchsorted(zu, at) / len(zu)
    margin = np.sqrt(np.log(40) / 2 / len(zp)) + np.sqrt(np.log(40) / 2 / len(zu))
    best = np.argmin((share_u + margin) / share_p)
    return share_u[best] / share_p[best]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sampled(df: DataFrame, n: int, *by: str) -> DataFrame:
    rate = min(1.0, n / max(1, df.count()))
    return df if rate == 1.0 else df.where(F.pmod(F.xxhash64(*by, F.lit(13)), F.lit(1 << 20)) < int(rate * (1 << 20)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features([t or "" for t in b.column(0).to_pylist()])
        yield pa.record_batch([pa.array(list(x), pa.list_(pa.float32()))], ["x"])


def _features_of(texts: DataFrame) -> np.ndarray:
    with arrow_batches(texts.sparkSession, ROWS):
        rows = texts.mapInArrow(_measured, "x array<float>").toArrow().column("x").combine_chunks()
    return rows.flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.float32)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample: tuple[int, int] = (SAMPLE_POSITIVE, SAMPLE_UNLABELLED)) -> tuple[Network, float] | None:
    """The network and the class prior; None without positives."""
    learned = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = learned(docs).select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    trusted = learned(labels).groupBy("doc_id").agg(F.min(F.coalesce(F.col(label) == 1, F.lit(False))).alias("good")).where("good").select("doc_id")
    chosen = _sampled(trusted, sample[0], "doc_id")  # bounded by the sample
    positive = _features_of(own.join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select("text"))
    if not len(positive):
        return None
    unlabelled = _features_of(_sampled(own, sample[1], "doc_id", "text").dropDuplicates(["doc_id", "text"]).select("text"))
    # toArrow gives rows in no fixed order; the fit takes them by value, so reruns agree
    positive, unlabelled = (x[np.lexsort(x.T)].astype(np.float64) for x in (positive, unlabelled))
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    scale[scale < 1e-6] = 1.0
    net = Network(mean, scale)
    p, u = net.prepared(positive), net.prepared(unlabelled)
    prior = class_prior(p, u, mean, scale)
    non_negative_risk(net, p, u, prior)
    return net, prior


def score(docs: DataFrame, fitted: tuple[Network, float] | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(text).alias("text"))
    if fitted is None:
        scored = own.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(fitted[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    s = shared.value.scores(features([t or "" for t in part.column("text").to_pylist()]))
                    yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        with arrow_batches(docs.sparkSession, ROWS):
            scored = own.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
