"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of character ORDER-grams over folded text (lower case, digits as one, code points in 12 bits): the
highest order uses counts, the lower ones the number of different characters to the left, and every order is discounted and
interpolated with the next lower, down to the uniform distribution. The models of all languages share one sorted array of
packed keys for each order, with a row of log probabilities and one of back-off weights, so a character costs one binary
search for all languages, and more only where no language has seen it in this context. A text goes to the language with the
least cross-entropy for each character.

The models are fitted on a bounded sample: documents with a language and fold, taken by a hash of the text at a rate that
gives about SAMPLE_CHARS characters of each language (all documents, if there are fewer); so the number of keys, and what is
broadcast, is bounded by languages * SAMPLE_CHARS, but for the one text that each language gets in any case. An eighth of the sample
isn't counted but scored (where there are more than SMALL_CHARS characters), and calibrates: a logistic
curve turns the distance to the second language into a score, and a text is rejected if its cross-entropy lies beyond what
its language's calibration texts show, or its score is below one half.

Defined cases: a text that is null or holds no letter is `und` with score 0; ties go to the first language by code point;
without any text to learn from, all is `und`; one language alone scores 1 unless rejected; documents with a null doc_id are
never learned from; repeated rows are counted as often as they occur; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
SAMPLE_CHARS = 3_000_000
#: Languages of fewer characters are counted from all their texts, those that calibrate included.
SMALL_CHARS = 200_000
UNKNOWN = "und"
_BITS = 12
_CHUNK = 1_000_000


def _fold_table() -> np.ndarray:
    table = np.arange(4096, dtype=np.int64)
    for c in range(4096):
        if chr(c).isspace():
            table[c] = 32
        elif chr(c).isdigit():
            table[c] = 48
    table[0] = 32  # 0 and 1 are taken: absent, and the start of a text
    table[1] = 32
    return table


_FOLD = _fold_table()


def folded(text: str) -> np.ndarray:
    """12-bit codes of a text's characters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    high = code >= 4096
    if high.any():
        code = np.where(high, 2048 + (code * 2654435761 >> 7) % 2048, code)
    return _FOLD[code]


def keys_of(codes: np.ndarray) -> np.ndarray:
    """Packed ORDER-gram that ends at each character."""
    padded = np.concatenate([np.ones(ORDER - 1, np.int64), codes])
    out = np.zeros(len(codes), np.int64)
    for k in range(ORDER):
        out = (out << _BITS) | padded[k : k + len(codes)]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            keys, n = np.unique(np.concatenate([keys_of(folded(t)) for t in texts]), return_counts=True)
            yield pd.DataFrame({"lang": lang, "key": keys, "n": n})


class Models:
    """The languages' models in shared sorted arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        by_order: list[list[tuple[np.ndarray, np.ndarray]]] = []  # for each language: (keys, counts) of orders ORDER..1
        for lang in self.langs:
            keys, n = counts[lang]
            levels = [(keys, n.astype(np.float64))]
            for k in range(ORDER - 1, 0, -1):
                short, n = np.unique(levels[-1][0] & ((1 << (_BITS * k)) - 1), return_counts=True)
                levels.append((short, n.astype(np.float64)))
            by_order.append(levels)
        self.keys, self.logp, self.contexts, self.logw = [], [], [], []
        for k in range(1, ORDER + 1):
            own = [levels[ORDER - k] for levels in by_order]
            keys = np.unique(np.concatenate([x[0] for x in own]))
            contexts = np.unique(keys >> _BITS) if k > 1 else np.zeros(1, np.int64)
            low = np.empty((len(keys), n_langs))
            if k == 1:
                low[:] = 1.0 / (len(keys) + 1)
            else:
                low[:] = np.exp(self.logp[-1][np.searchsorted(self.keys[-1], keys & ((1 << (_BITS * (k - 1))) - 1))])
            p, w = np.empty_like(low), np.ones((len(contexts), n_langs))
            where = np.searchsorted(contexts, keys >> _BITS) if k > 1 else np.zeros(len(keys), np.int64)
            for i, (seen, n) in enumerate(own):
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
                at = np.searchsorted(contexts, seen >> _BITS) if k > 1 else np.zeros(len(seen), np.int64)
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                known = total > 0
                w[known, i] = d * kinds[known] / total[known]
                p[:, i] = w[where, i] * low[:, i]
                place = np.searchsorted(keys, seen)
                p[place, i] += (n - d) / total[at]
            self.keys.append(keys)
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(contexts)
            self.logw.append(np.log(w).astype(np.float32))
        # a character that no language has seen
        self.none = (self.logw[0][0] - np.log(len(self.keys[0]) + 1)).astype(np.float32)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """For each packed key, the log probability of its last character in each language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        rest, key = None, keys
        for k in range(ORDER, 0, -1):
            own = self.keys[k - 1]
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            hit = own[at] == key
            if rest is None:
                out[hit] = self.logp[k - 1][at[hit]]
                rest = np.flatnonzero(~hit)
            else:
                out[rest[hit]] += self.logp[k - 1][at[hit]]
                rest = rest[~hit]
            if not len(rest):
                break
            key = key[~hit]
            if k > 1:
                context = key >> _BITS
                at = np.minimum(np.searchsorted(self.contexts[k - 1], context), len(self.contexts[k - 1]) - 1)
                met = self.contexts[k - 1][at] == context
                out[rest[met]] += self.logw[k - 1][at[met]]
                key = key & ((1 << (_BITS * (k - 1))) - 1)
            else:
                out[rest] += self.none
        return out

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Nats for each character, of each text in each language; empty texts have 0."""
        out = np.zeros((len(texts), len(self.langs)))
        some: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if some:
                p = self.log_probabilities(np.concatenate([k for _, k in some]))
                starts = np.cumsum([0, *(len(k) for _, k in some[:-1])])
                np.subtract.at(out, [i for i, _ in some], np.add.reduceat(p, starts, axis=0, dtype=np.float64))
                some.clear()

        for i, t in enumerate(texts):
            keys = keys_of(folded(t)) if t else np.empty(0, np.int64)
            for a in range(0, len(keys), _CHUNK):
                some.append((i, keys[a : a + _CHUNK]))
                size += len(some[-1][1])
                if size >= _CHUNK:
                    flush()
                    size = 0
        flush()
        return out / np.maximum(1, [len(t.lower()) if t else 0 for t in texts])[:, None]


class Calibration:
    """Score of a margin, and the cross-entropy beyond which a text is rejected, for each language."""

    def __init__(self, models: Models, labels: list[str], ce: np.ndarray):
        n = len(models.langs)
        self.limit = np.full(n, np.inf)
        self.a, self.b = 20.0, 0.0
        if not len(ce):
            return
        best = ce.argmin(axis=1)
        right = np.array([models.langs[k] == lang for k, lang in zip(best, labels, strict=True)])
        least = ce.min(axis=1)
        for k in range(n):
            for own in (least[(best == k) & right], least[right]):  # where a language has few texts, those of all
                if len(own) >= 20:
                    self.limit[k] = max(np.quantile(own, 0.995), 2 * np.median(own)) + 0.25
                    break
        if n > 1 and right.sum() >= 20 and (~right).sum() >= 5:  # else the errors are too few for a slope
            two = np.partition(ce, 1, axis=1)
            self._fit(two[:, 1] - two[:, 0], right)

    def _fit(self, m: np.ndarray, right: np.ndarray) -> None:
        """Logistic regression on the margin with smoothed targets (Newton steps)."""
        yes, no = right.sum(), (~right).sum()
        t = np.where(right, (yes + 1) / (yes + 2), 1 / (no + 2))
        x, beta = np.stack([m, np.ones_like(m)], axis=1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * beta)
            beta += step
            if abs(step).max() < 1e-6:
                break
        if beta[0] > 0:
            self.a, self.b = beta

    def judge(self, ce: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and rejection of each row."""
        best = ce.argmin(axis=1)
        least = ce[np.arange(len(ce)), best]
        if ce.shape[1] > 1:
            margin = np.partition(ce, 1, axis=1)[:, 1] - least
            score = 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))
        else:
            score = np.ones(len(ce))
        return best, score, (least > self.limit[best]) | (score < 0.5)


def _scored(models):
    """Cross-entropies of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ce = models.value.cross_entropies(pdf["text"].tolist())
            yield pd.DataFrame({"lang": pdf["lang"], "ce": list(ce)})

    return run


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, text: str = "text", lang: str = "lang") -> tuple[Models, Calibration] | None:
    """Models and calibration from the labelled documents of the learning folds; None without any."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col(lang).isNotNull() & (F.length(text) > 0))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    unit = lambda seed: F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")), F.min(unit(1))).collect()  # one row for each language
    if not sizes:
        return None
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for pair in values for x in pair)), F.col("lang"))
    rate, small = of([(lang, min(1.0, sample_chars / n)) for lang, n, _ in sizes]), of([(lang, n <= SMALL_CHARS) for lang, n, _ in sizes])
    first = unit(1) == of([(lang, least) for lang, _, least in sizes])  # so that no language is sampled to nothing
    sample = labelled.where((unit(1) < rate) | first)
    counted = sample.where((unit(2) >= 0.125) | first | small).mapInPandas(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # bounded by the sample
    langs, keys, n = (table.column(c).to_numpy() for c in ("lang", "key", "n"))
    counts = {}
    for one in np.unique(langs.astype(str)):
        own = langs == one
        order = np.argsort(keys[own])
        counts[str(one)] = keys[own][order], n[own][order]
    if not counts:
        return None
    models = Models(counts)
    shared = spark.sparkContext.broadcast(models)
    scored = sample.where(unit(2) < 0.125).mapInPandas(_scored(shared), "lang string, ce array<double>").toArrow()
    ce = np.array(scored.column("ce").to_pylist()).reshape(-1, len(models.langs))
    shared.unpersist()
    return models, Calibration(models, scored.column("lang").to_pylist(), ce)


def identify(docs: DataFrame, fitted: tuple[Models, Calibration] | None, text: str = "text", reject: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row; with reject, rejected texts are `und` as well."""
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(letter, F.col(text)).alias("text"))
    if fitted is None:
        return own.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        models, calibration = shared.value
        best, score, rejected = calibration.judge(models.cross_entropies(texts.tolist()))
        none = texts.isna().to_numpy()
        pred = np.array(models.langs, dtype=object)[best]
        pred[none | (rejected & reject)] = UNKNOWN
        return pd.DataFrame({"lang_pred": pred, "score": np.where(none, 0.0, score), "rejected": rejected | none})

    return own.select("doc_id", "held_out", run("text").alias("r")).select("doc_id", "held_out", "r.*")
