"""Phrase mining against counts of all phrases, written plainly."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, rows

from lectern.llm import phrases


def plain(data, least, longest=5, first=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    gone = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if a >= f[lang, w[i : i + size]]:
                    gone.add((lang, w[i : i + size]))
    out = []
    for lang in {key[0] for key in found}:
        own = []
        for (x, w), a in found.items():
            if x == lang and (x, w) not in gone:
                score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
                own.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:first], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def odd():
    extra = ["A b. a B, c a b\ta b;a b\x0bc", "é É\x1c é é\x1c x", "a a a a a a a", "z" * 70, "the  the\r\nthe the THE the", "x y z w v u x y z w v", "x y z w v"]
    return rows() + [(9000 + i, t, lang, "s", 1, "w", "d", "k", "y", 5) for i, t in enumerate(extra * 4) for lang in ("en", None, "und")]


@pytest.mark.parametrize(("least", "slots"), [(2, 1 << 20), (3, 40), (5, 1 << 20)])
def test_all_phrases(spark, monkeypatch, least, slots):
    monkeypatch.setattr(phrases, "SLOTS", slots)
    monkeypatch.setattr(phrases, "MOST_BITS", 26 if least == 2 else 10)
    monkeypatch.setattr(phrases, "CHUNK", 64)
    monkeypatch.setattr(phrases, "FAN", 2)
    monkeypatch.setattr(phrases, "GATHER", 50)
    monkeypatch.setattr(phrases, "ROWS", 7)
    monkeypatch.setattr(phrases, "PIECE", 300)
    monkeypatch.setattr(phrases, "HASHED", 5)
    data = odd()
    got = phrases.collocations(frame(spark, data).repartition(5), least=least, first=60).collect()
    assert sorted(tuple(r) for r in got) == plain([(r[1], r[2]) for r in data], least, first=60)


def test_slot_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 1 << 62, n))
        table = phrases.SlotHash(keys)
        assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
        assert (table.keys[table.find(keys)] == keys).all()
        assert (table.find(np.setdiff1d(keys + 1, keys)) == -1).all()


def test_word_table():
    words = ["a", "b", "a", "ß", "longer word", ""]
    table = phrases.WordTable(["en", "en", "fr", "fr", "und", "en"], words, 40)
    numbers = [int(table.find(lang, pa.array([w]))[0]) for lang, w in zip(["en", "en", "fr", "fr", "und", "en"], words, strict=True)]
    assert sorted(numbers) == list(range(40, 46))
    assert table.find("fr", pa.array(["b", "longer word", "x"])).tolist() == [-1, -1, -1]
    assert table.find("de", pa.array(["a"])).tolist() == [-1] and len(table.find("en", pa.array([], pa.string()))) == 0


def test_score_is_exact(spark):
    rng = np.random.default_rng(2)
    data = []
    for _ in range(500):
        n = int(rng.integers(1000, 10 ** int(rng.integers(4, 17))))
        a = int(rng.integers(1, n))
        data.append((a, n, int(rng.integers(a, n + 1)), int(rng.integers(a, n + 1))))
    df = spark.createDataFrame(data, "a long, n long, l long, r long")
    got = df.select("*", phrases.score(df.a, df.n, df.l, df.r).alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)


def test_nothing_frequent(spark):
    for data in ([], [(1, "a b c. d e", "en", "s", 1, "w", "d", "k", "y", 5)], [(1, "a b " * 3 + ". " + "c, " * 500, "en", "s", 1, "w", "d", "k", "y", 5)]):
        got = phrases.collocations(frame(spark, data), least=4)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert got.count() == 0
