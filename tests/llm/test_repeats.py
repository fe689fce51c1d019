"""Repeated passages against a count of all strings."""

import bisect
import hashlib
import random
import re
from collections import Counter

import pytest
from cases import frame, rows

from lectern.llm import repeats


def plain(texts, length, passage, words):
    data = [(t or "").encode() for t in texts]
    strings = lambda d: [(i, d[i : i + length]) for i in range(len(d) - length + 1)]

    def told(d):
        marks = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        if length < 100:
            every = ((i, e) for i in range(len(d)) for e in range(i + passage, min(i + length, len(d)) + 1))
            return [(i, d[i:e]) for i, e in every if sum(a < e and b > i for a, b in marks) > words]
        out = []  # the shortest from each place, and up to each place
        starts, ends = [a for a, _ in marks], [b for _, b in marks]
        for i in range(len(d)):
            ahead, back = bisect.bisect_right(ends, i) + words, bisect.bisect_right(starts, i) - 1 - words
            if ahead < len(marks):
                out.append((i, max(i + passage, marks[ahead][0] + 1)))
            if back >= 0:
                out.append((min(i + 1 - passage, marks[back][1] - 1), i + 1))
        return [(i, d[i:e]) for i, e in set(out) if i >= 0 and e <= len(d) and e - i <= length]

    def covers(of):
        seen = Counter(w for d in data for _, w in of(d))
        for d in data:
            cover = bytearray(len(d))
            for i, w in of(d):
                if seen[w] > 1:
                    cover[i : i + len(w)] = b"\1" * len(w)
            yield cover

    out = []
    for d, cover, more in zip(data, covers(strings), covers(told), strict=True):
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(d), sum(cover), runs, hashlib.sha256(kept).hexdigest(), sum(a | b for a, b in zip(cover, more, strict=True))))
    return out


def check(spark, texts, length=400, passage=250, words=50, **options):
    data = [(i, t, "en", "a", 0, *"wdky", 1) for i, t in enumerate(texts)]
    found = repeats.remove_repeats(frame(spark, data), length=length, passage=passage, words=words, **options).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in found}
    assert [got[i] for i in range(len(texts))] == plain(texts, length, passage, words)


def passages(seed, n=60):
    rnd = random.Random(seed)
    letters = lambda k: "".join(rnd.choice("abcdé \n") for _ in range(k))
    shared = [letters(rnd.randint(30, 300)) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [letters(rnd.randint(0, 150))]
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s))
            parts += [s[a : a + rnd.randint(20, 300)] if rnd.random() < 0.6 else s, letters(rnd.randint(0, 60))]
        out.append("".join(parts))
    return [*out, out[3], "", None, "ab" * 150, "ab" * 140, "a" * 200, out[5] + out[5]]


@pytest.mark.parametrize("group", [20_000, 2])
def test_short_length(spark, group):
    check(spark, passages(1), length=60, gram=12, group=group, passage=40, words=8)


def test_production_length(spark):
    rnd = random.Random(2)
    words = lambda k: " ".join(f"w{rnd.randrange(3000)}" for _ in range(k))
    core = words(200)
    b = core.encode()
    texts = [words(rnd.randint(10, 300)) for _ in range(25)]
    texts += [words(80) + core[i * 7 : i * 7 + rnd.choice([399, 400, 401, 600])] + words(50) for i in range(25)]
    texts += [core, core, core[:399], b[:450].decode(), core + core[:500], "é" * 900]
    texts += [words(40) + " " + " ".join(core.split()[i : i + n]) + " " + words(30) for i, n in enumerate([50, 51, 52, 60, 70, 75, 80])]
    check(spark, texts)


def test_passages_of_over_50_words_are_told(spark):
    rnd = random.Random(7)
    words = lambda k: " ".join("".join(rnd.choice("aeinorst") for _ in range(rnd.randint(3, 7))) for _ in range(k))
    core = [words(rnd.randint(51, 75)) for _ in range(12)]
    data = [(i, f"{words(200)}\n{core[i % 12]} {words(150)}", "en", "a", 0, *"wdky", 1) for i in range(36)] + [(100 + i, words(300), "en", "a", 0, *"wdky", 1) for i in range(20)]
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, data)).collect()}
    assert all((r.n_passage > 0) == (d < 100) for d, r in got.items())
    assert all(r.n_removed == (r.n_passage if r.n_passage >= 400 else 0) for r in got.values())


def test_null_ids_and_repeated_rows(spark):
    docs = frame(spark)
    want = Counter(zip([r[0] for r in rows()], plain([r[1] for r in rows()], 400, 250, 50), strict=True))
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage)) for r in repeats.remove_repeats(docs).collect())
    assert got == want
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_extents_and_groups_against_pairs():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(2, 12)
        lefts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6))) for _ in range(n)]
        rights = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 7))) for _ in range(n)]
        keys = list(dict.fromkeys(zip(lefts, rights, strict=True)))
        lefts, rights = [k[0] for k in keys], [k[1] for k in keys]
        common = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        far = repeats.extents(lefts, rights, 5, 4, 0)
        for x in range(len(keys)):
            pairs = [(common(lefts[x], lefts[y]), common(rights[x], rights[y])) for y in range(len(keys)) if y != x]
            for at, least in ((0, 5), (2, 4)):
                good = [p for p in pairs if sum(p) >= least]
                assert far[x][at : at + 2] == (max([0, *(p[0] for p in good)]), max([0, *(p[1] for p in good)]))
        closed = []
        repeats.scan_intervals(lefts, rights, lambda *_: None, lambda l, r, m: closed.append((l, r, m)))  # noqa: E741
        for l, r, m in closed:  # noqa: E741
            inside = {y for y in range(len(keys)) if common(rights[m[0]], rights[y]) >= r}
            assert set(m) == inside and l == min(common(lefts[m[0]], lefts[y]) for y in m)


def test_groups_name_all_occurrences(spark):
    rnd = random.Random(9)
    words = lambda k: " ".join(f"w{rnd.randrange(3000)}" for _ in range(k))
    core = words(150)
    texts = [words(90) + " " + core + " " + words(90) for _ in range(6)] + [words(200)]
    data = [(i, t, "en", "a", 0, *"wdky", 1) for i, t in enumerate(texts)]
    got = repeats.groups(frame(spark, data)).collect()
    by = {}
    hashes = {hashlib.sha256(t.encode()).digest()[:16]: t.encode() for t in texts}
    for r in got:
        by.setdefault((r.g, r.rep, r.n_bytes, r.before), set()).add((bytes(r.th), hashes[bytes(r.th)][r.start : r.start + r.n_bytes]))
    assert by and all(len({s for _, s in v}) == 1 for v in by.values()) and max(len(v) for v in by.values()) == 6


@pytest.mark.parametrize("group", [20_000, 2])
def test_groups_against_all_pairs(spark, group):
    length, gram = 60, 12
    texts = [*passages(1, 30), "only as copies " * 10, "only as copies " * 10, "x" * 70, "x" * 70, "x" * 70]
    data = [t.encode() if t else b"" for t in texts]
    docs = frame(spark, [(i, t, "en", "a", 0, *"wdky", 1) for i, t in enumerate(texts)])
    by = {}
    for r in repeats.groups(docs, length=length, gram=gram, group=group).collect():
        by.setdefault((r.g, r.rep, r.n_bytes, r.before), []).append((r.doc_id, r.start))
    places = lambda w: [(i, k) for i, d in enumerate(data) for k in range(len(d) - len(w) + 1) if d.startswith(w, k)]
    given = set()
    for (g, _, n, before), at in by.items():
        i, k = at[0]
        w = data[i][k : k + n]
        assert len(w) == n and len(at) == len(set(at)) > 1
        given.add((w, before) if g is not None else w)
        assert sorted(at) == (places(w) if g is not None else [(j, 0) for j, d in enumerate(data) if d == w])
    assert {d for d in data if len(d) >= length and data.count(d) > 1} == {w for w in given if isinstance(w, bytes)}
    distinct, windows, powers = list(dict.fromkeys(data)), {}, repeats._Powers()
    for i, d in enumerate(distinct):
        for k in range(len(d) - length + 1):
            windows.setdefault(d[k : k + length], []).append((i, k))
    pairs = set()
    for at in windows.values():
        for x, (i, k) in enumerate(at):
            for j, m in at[:x]:
                a, b = distinct[i], distinct[j]
                if not k or not m or a[k - 1] != b[m - 1]:
                    n = length
                    while max(k + n - len(a), m + n - len(b)) < 0 and a[k + n] == b[m + n]:
                        n += 1
                    pairs.add(a[k : k + n])
    n = 0
    for w in pairs:
        for l in map(int, repeats.anchors(w, powers, length, gram)[0]):  # noqa: E741
            if l < length - gram and len(w) - l < length:
                n += 1
                assert (w, l) in given
    assert n > 20
