"""Winnowing against a plain reading of its definition."""

import hashlib
import random
import re

import xxhash
from cases import frame, rows

from lectern.llm import fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def parsed(s):
    return [(h, int(p)) for h, p in (x.split(":") for x in s.split(",") if x)]


def fingerprint_of(text):
    """Hashes and positions, by definition: every gram rolled from the one before, every window looked through."""
    k, size, full = fingerprint.K, fingerprint.WINDOW, 2**64 - 1
    spark_hash = lambda x: xxhash.xxh64_intdigest(x.encode(), seed=42)
    words = WORD.findall(text)
    if not words:
        return []
    if len(words) < k:
        grams = [spark_hash(" ".join(words))]
    else:
        h = [spark_hash(w) for w in words]
        grams, now = [], 0
        for i, x in enumerate(h):
            if i >= k:
                now ^= h[i - k] << (k - 1) & full
            now = (now << 1 & full) ^ x
            if i >= k - 1:
                grams.append(now)
    signed = [g - 2**64 if g >> 63 else g for g in grams]
    windows = [range(i, i + size) for i in range(len(grams) - size + 1)] or [range(len(grams))]
    at = sorted({max(i for i in w if signed[i] == min(signed[j] for j in w)) for w in windows})
    return [(f"{grams[i]:x}", i) for i in at]


def check(spark, data, **options):
    got = {}
    for r in fingerprint.fingerprints(frame(spark, data), **options).collect():
        got.setdefault((r.doc_id, r.n_chars, r.fingerprint), []).append(r)
    assert sum(map(len, got.values())) == len(data)
    tie = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (2**64 if x >> 63 else 0)
    order = sorted(((d, t or "") for d, t, *_ in data), key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1])))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    text_of = lambda marks: ",".join(f"{h}:{p}" for h, p in marks)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks, other = fingerprint_of(text), fingerprint_of(edited)
        want = hashlib.sha256(edited.encode()).hexdigest(), text_of(other)
        alike = like(*({h for h, _ in m} for m in (marks, other))), like(*({h for h, _ in m} for m in (marks, fingerprint_of(after))))
        mine = got[doc_id, len(text), text_of(marks)]
        found = [r for r in mine if (r.edited_sha256, r.edited_fingerprint) == want and abs(r.near_edited - alike[0]) + abs(r.near_next - alike[1]) < 1e-12]
        assert found
        mine.remove(found[0])


def test_against_definition(spark):
    check(spark, rows(), cell=7)


def test_ids_of_all_kinds(spark):
    made = lambda ids: [(d, f"text number {i} of them " * (i % 9), "en", "a", 0, *"wdky", 1) for i, d in enumerate(ids)]
    check(spark, made([1, 2**62, 9 * 10**18, -(2**63), -5, 2**63 - 1]), cell=2)
    check(spark, made([None] * 20), cell=3)
    check(spark, made([4] * 20), cell=3)
    check(spark, made([*range(30), 10**17, *range(10**17 + 5, 10**17 + 40)]), cell=10)
    check(spark, [(4, "same text", "en", "a", 0, *"wdky", 1)] * 5 + [(9, "another one", "en", "a", 0, *"wdky", 1)] * 2, cell=1)


def test_rightmost_and_match_guarantee(spark):
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared = words(fingerprint.K + fingerprint.WINDOW - 1)
    a, b = words(40) + shared + words(33), words(7) + shared + words(90)
    same = "la " * 60
    data = [(i, t, "en", "a", 0, *"wdky", 1) for i, t in enumerate([" ".join(a), " ".join(b), same, same])]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, data)).collect()}
    one, two = dict(parsed(got[0].fingerprint)), dict(parsed(got[1].fingerprint))
    common = one.keys() & two.keys()
    assert common and all(one[h] - 40 == two[h] - 7 for h in common)
    assert [p for _, p in parsed(got[2].fingerprint)] == list(range(15, 56))  # rightmost of equals in each window
    assert got[2].near_next == 1.0 and got[2].fingerprint == got[3].fingerprint


def test_edges(spark):
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    assert len(fingerprint.fingerprints(frame(spark), cell=5).collect()) == len(rows())
    alone = fingerprint.fingerprints(frame(spark, [(7, "one two", "en", "a", 0, *"wdky", 1)])).collect()[0]
    assert alone.near_next == 1.0 and alone.n_chars == 7
    blank = fingerprint.fingerprints(frame(spark, [(7, None, "en", "a", 0, *"wdky", 1)])).collect()[0]
    assert (blank.fingerprint, blank.near_edited, blank.n_chars) == ("", 1.0, 0)
