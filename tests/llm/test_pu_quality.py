"""The positive-unlabelled classifier: its risk, its class prior, held-out accuracy and odd tables."""

import random
import zlib

import numpy as np
import pytest
from cases import frame

from lectern.llm import pu_quality


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "stone", "river", "walks", "under", "green", "of", "and", "light."]) + ("." if not i % 9 else "") for i in range(n))


def junk(rnd, n):
    return rnd.choice([
        lambda: " ".join(rnd.choice(["BUY", "NOW", "CHEAP"]) + "!!" for _ in range(n)),
        lambda: " ".join(rnd.choice(["a", "word", "tail"]) + rnd.choice(["***", "$$$"]) for _ in range(n)),
        lambda: "same " * n,
    ])()


def corpus(n=900, bad=0.2, seed=2):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() >= bad
        docs.append((i, (prose if good else junk)(rnd, rnd.randint(5, 200)), "en", "s"))
        if i % 2:
            labels.append((i, int(good)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")
    return d, labels, pu_quality.fit(d, lab)


def test_held_out_accuracy_and_prior(fitted):
    docs, labels, model = fitted
    assert abs(model[1] - 0.8) < 0.08
    truth = dict(labels)
    rows = [r for r in pu_quality.score(docs, model).collect()]
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95


def test_labels_of_held_out_rows_and_negatives_play_no_part(spark, fitted):
    docs, labels, model = fitted
    out = [(i, 1 - q) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q) for i, q in labels if q == 1 or zlib.crc32(str(i).encode()) % 5 == 0]
    again = pu_quality.fit(docs, spark.createDataFrame(out, "doc_id long, quality int"))
    assert again[1] == model[1] and all((a == b).all() for a, b in zip(again[0].p, model[0].p, strict=True))


def test_slopes_are_those_of_the_risk():
    """The slope handed to a step against differences of the risk, on both sides of zero."""
    rng = np.random.default_rng(0)
    for zero in (False, True):
        p, u = rng.normal(size=(50, 4)), rng.normal(size=(60, 4)) - (0 if not zero else 3)
        seen = []

        class Probe(pu_quality.Network):
            def step(self, x, slope, rate=0.0):
                seen.append((x, slope))

        net = Probe(np.zeros(4), np.ones(4))
        net.p[2] *= 8
        pu_quality.non_negative_risk(net, p, u, 0.9, steps=1)
        x, slope = seen[0]
        n = len(x) // 2
        z = net.logits(x).astype(float)
        loss = lambda t: np.logaddexp(0, -t)

        def second(z):
            return loss(-z[n:]).mean() - 0.9 * loss(-z[:n]).mean()

        def risk(z):
            return 0.9 * loss(z[:n]).mean() + second(z) if second(z0) >= 0 else -second(z)

        z0 = z.copy()
        for i in (0, 7, n, n + 9):
            e = np.zeros(len(z))
            e[i] = 1e-4
            assert abs((risk(z + e) - risk(z - e)) / 2e-4 - slope[i]) < 1e-6


def test_features_count_by_definition():
    texts = ["", "One two, two!\nONE\n\nONE", "é $$$ 12\t\x01", "x" * 3000 + " y", "𝔘 ?\ud800"]
    x = pu_quality.features(texts)
    assert np.isfinite(x).all() and len(x) == len(texts)
    assert np.allclose(x[1][:3], np.log1p([len(texts[1]), 5, 3]))
    dollars = x[2][-len(pu_quality._MARKS) + pu_quality._MARKS.index("$")]
    assert abs(dollars - np.sqrt(3 / 4)) < 1e-6
    assert np.allclose(pu_quality.features([texts[1]])[0], x[1])
    pu_quality_chars, pu_quality.CHARS = pu_quality.CHARS, 5
    try:
        assert np.allclose(pu_quality.features(texts), x)
    finally:
        pu_quality.CHARS = pu_quality_chars


def test_odd_tables(spark, fitted):
    odd = frame(spark)
    rows = pu_quality.score(odd, fitted[2]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in rows:
        if r.doc_id is not None and len(texts[r.doc_id]) == 1:
            assert by_text.setdefault(next(iter(texts[r.doc_id])), r.score) == r.score
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert pu_quality.fit(odd, none) is None
    assert {(r.score, r.predicted) for r in pu_quality.score(odd, None).collect()} == {(0.5, 1)}
    assert pu_quality.score(frame(spark, []), fitted[2]).count() == 0
