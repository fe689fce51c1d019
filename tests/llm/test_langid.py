"""Character models: probabilities sum to one, the recursion holds, held-out accuracy, and the edges."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import frame, rows

from lectern.llm import langid


def model_of(texts_by_lang):
    counts = {}
    for lang, texts in texts_by_lang.items():
        counts[lang] = np.unique(np.concatenate([langid.keys_of(langid.folded(t)) for t in texts]), return_counts=True)
    return langid.Models(counts)


TEXTS = {"aa": ["abracadabra alakazam", "cadabra abra kazam"], "bb": ["the quick brown fox", "jumps over the lazy dog"]}


def plain_probability(texts, vocabulary, gram):
    """Interpolated Kneser-Ney of the last character of a tuple, straight from the recursion."""
    n = langid.ORDER
    seen = Counter()
    for t in texts:
        codes = [1] * (n - 1) + langid.folded(t).tolist()
        seen.update(tuple(codes[i : i + n]) for i in range(len(codes) - n + 1))
    levels = {n: dict(seen)}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(g):
        if not g:
            return 1 / (vocabulary + 1)
        level = levels[len(g)]
        once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
        same = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        return max(level.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[1:])

    return p(tuple(gram))


def test_recursion_and_sums():
    m = model_of(TEXTS)
    vocabulary = len(m.keys[0])
    for text in ("abra fox", "dadabra", "lazy zebra!", "the dog"):
        keys = langid.keys_of(langid.folded(text))
        got = np.exp(m.log_probabilities(keys))
        for key, row in zip(keys.tolist(), got, strict=True):
            gram = [(key >> (12 * k)) & 4095 for k in range(langid.ORDER - 1, -1, -1)]
            for lang, value in zip(m.langs, row, strict=True):
                assert value == pytest.approx(plain_probability(TEXTS[lang], vocabulary, gram), rel=1e-4)
    context = langid.keys_of(langid.folded("abra"))[-1]
    every = [((int(context) << 12) & ((1 << 60) - 1)) | int(c) for c in m.keys[0]]
    total = np.exp(m.log_probabilities(np.array([*every, ((int(context) << 12) & ((1 << 60) - 1)) | 4095]))).sum(axis=0)
    assert total == pytest.approx([1.0] * len(m.langs), rel=1e-4)


def test_cross_entropy_of_pieces_is_that_of_the_whole(monkeypatch):
    m = model_of(TEXTS)
    whole = m.cross_entropies(["the quick abra " * 40, "", "x"])
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert m.cross_entropies(["the quick abra " * 40, "", "x"]) == pytest.approx(whole, rel=1e-5)
    assert whole[1].tolist() == [0, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = langid.fit(docs, sample_chars=200_000)
    got = langid.identify(docs, fitted, reject=False).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)

    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)


def test_calibrated_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = langid.fit(docs, sample_chars=400_000)
    odd = spark.createDataFrame([(1, "ฉันไม่ได้พูดภาษานี้ " * 20), (2, "Ζήσε τη ζωή σου " * 20)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(odd, fitted).collect()] == ["und", "und"]
    clean = langid.identify(docs.where("n_chars > 500"), fitted)
    assert clean.where("rejected").count() < 0.05 * clean.count()


def test_edges(spark):
    docs = frame(spark)
    got = defaultdict(list)
    for r in langid.identify(docs, langid.fit(docs), reject=False).collect():
        got[r.doc_id].append(r)
    for doc_id, text, *_ in rows():
        want_und = not any(c.isalpha() for c in text or "")
        assert any((r.lang_pred == "und" and r.score == 0) == want_und for r in got[doc_id])
    assert langid.identify(frame(spark, []), langid.fit(frame(spark, []))).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(9, 1)).replace({"": None}, subset=["lang"])
    assert {r.lang_pred for r in langid.identify(unlabelled, langid.fit(unlabelled)).collect()} == {"und"}
    assert math.isfinite(langid.Calibration(model_of(TEXTS), [], np.empty((0, 2))).a)


def test_every_labelled_language_is_learned(spark):
    data, n = [], 0
    for lang in "abcdefghijklmnopqrst":  # one text each, of which an eighth would be held back
        while zlib.crc32(str(n).encode()) % 3 == 1:
            n += 1
        data.append((n, f"{lang * 3} {lang}x " * 20, lang))
        n += 1
    for _ in range(3):  # two long texts, of which the sample rate alone might leave none
        data.append((n, "zq zzq qz " * 3000, "z"))
        n += 3
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    models, _ = langid.fit(docs, sample_chars=100)
    assert {r.lang for r in docs.where(~langid.held_out(docs.doc_id)).collect()} == set(models.langs)
