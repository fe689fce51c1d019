"""Near-duplicates against all pairs."""

import random
from itertools import combinations

from cases import frame, rows

from lectern.llm import near_dup


def plain(data):
    """doc_id -> (set, least reachable id), by brute force."""
    sets = {}
    for doc_id, text, *_ in data:
        w = (text or "").encode().lower().split()
        s = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        sets.setdefault(doc_id, []).append(s)
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in combinations([d for d in sets if d is not None], 2):
        if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, {d: None if d is None else find(d) for d in sets}


def family(seed, size, words=120):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, data):
    sets, root = plain(data)
    got = near_dup.link(frame(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.component_id == root[r.doc_id], r
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        assert r.kept == (r.doc_id == r.component_id)


def test_small_table(spark):
    check(spark, rows())
    docs = frame(spark)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    _, root = plain(rows())
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({x for x in root.values() if x is not None})


def test_large_families(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 40)
    texts = family(1, 150) + family(2, 60) + family(3, 2)
    check(spark, [(1000 - i, t, "en", "a", 0, *"wdky", 1) for i, t in enumerate(texts)])


def colliding(seed, others, pairs):
    """Texts that share long passages, so that table keys collide by chance, and pairs of near copies among them: (texts, [(i, j, likeness)])."""
    rnd = random.Random(seed)
    words = lambda n: [f"w{rnd.randrange(20_000)}" for _ in range(n)]
    shared = [words(60) for _ in range(8)]
    made = lambda: sum(rnd.sample(shared, 2), []) + words(rnd.randint(60, 110))
    of = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, planted = [made() for _ in range(others)], []
    for _ in range(pairs):
        one = made()
        two = list(one)
        for at in rnd.sample(range(2, len(two) - 2), rnd.randint(1, 5)):
            two[at] = f"x{rnd.randrange(10**6)}"
        a, b = of(one), of(two)
        planted.append((len(texts), len(texts) + 1, len(a & b) / len(a | b)))
        texts += [one, two]
    return [" ".join(t) for t in texts], planted


def recall(spark, seed, others, pairs):
    """Share of planted pairs at 0.75 or more that end in one component, by band of likeness."""
    texts, planted = colliding(seed, others, pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in near_dup.link(docs).collect()}
    out = {}
    for low, high in ((0.75, 0.8), (0.8, 0.9), (0.9, 1.01)):
        some = [(a, b) for a, b, s in planted if low <= s < high]
        out[low] = len(some), sum(root[a] == root[b] for a, b in some)
    return out


def test_recall_where_keys_collide(spark):
    found = recall(spark, 5, 1200, 300)
    assert all(n > 30 for n, _ in found.values())
    assert sum(k for _, k in found.values()) >= 0.99 * sum(n for n, _ in found.values())


def test_empty(spark):
    assert near_dup.link(frame(spark, [])).count() == near_dup.keep_one(frame(spark, [])).count() == 0
    assert near_dup.link(frame(spark, [(1, None, "en", "a", 0, *"wdky", 1)])).collect()[0].component_id == 1
