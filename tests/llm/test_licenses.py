"""Licence scans against all units and all templates."""

import random

from cases import frame, rows

from lectern.llm import licenses


def plain(text):
    found = []
    for a, b in licenses.units(text):
        x = licenses.bigrams(text[a:b])
        scored = []
        for name, t in licenses.TEMPLATES:
            y = licenses.bigrams(t)
            scored.append((-2 * len(x & y) / (len(x) + len(y)), name))
        score, name = min(scored)
        if -score >= licenses.THRESHOLD:
            found.append((-score, name, a, b))
    return found


def test_against_all_pairs():
    index = licenses.Index()
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    texts = [t or "" for _, t, *_ in rows()]
    texts += [t for _, t in licenses.TEMPLATES]
    texts += [f"Some words\n\nCopyright (c) 2020 A. N. Other\n\n{t}\n\nmore words" for _, t in licenses.TEMPLATES]
    texts += ["a b\nReleased under the MIT License.\nc d", mit.replace("Software", "Program"), mit[:300]]
    for t in texts:
        assert licenses.find(t, index) == plain(t)
    for name, t in licenses.TEMPLATES:
        assert licenses.find(t, index)[0][:2] == (1.0, name)


def test_scan(spark):
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(1, "x y\nReleased under the MIT License.\nz", *["a"] * 2, 0, *"wdky", 1), (2, None, "a", "a", 0, *"wdky", 1)])).collect()}
    assert (got[1].license, got[1].score, got[1].n_matches, got[1].spans) == ("MIT", 1.0, 1, "MIT:4:35")
    assert (got[2].license, got[2].score, got[2].n_matches, got[2].spans) == (None, 0.0, 0, "")
    assert licenses.scan(frame(spark, [])).count() == 0 and licenses.scan(frame(spark)).count() == len(rows())


def standard_forms():
    t = dict(licenses.TEMPLATES[::-1])
    cut = lambda x, *marks: "\n\n".join(x[a:b] for a, b in zip([0, *map(x.index, marks)], [*map(x.index, marks), len(x)], strict=True))
    full = {name: max((x for n, x in licenses.TEMPLATES if n == name), key=len) for name in t}
    return {
        "MIT": cut(full["MIT"], "The above copyright", "THE SOFTWARE IS"),
        "BSD-2-Clause": cut(full["BSD-2-Clause"], "1. Redis", "2. Redis", "THIS SOFTWARE"),
        "BSD-3-Clause": cut(full["BSD-3-Clause"], "1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE"),
        "ISC": cut(full["ISC"], "THE SOFTWARE IS"),
        "Apache-2.0": cut(full["Apache-2.0"], "http", "Unless"),
        "GPL-3.0": cut(full["GPL-3.0"], "This program is\ndistributed", "You should"),
    }


def test_licences_in_several_paragraphs_and_in_sentences():
    index = licenses.Index()
    other = "\n\n".join(" ".join(f"word{i * j % 97} of the" for j in range(30)) for i in range(1, 30))
    for name, t in standard_forms().items():
        for text in (f"{other}\n\nCopyright (c) 2020 A. N. Other\n\n{t}\n\n{other}", f"{other} {t} {other}"):
            at = text.index(t)
            assert licenses.find(text, index) == [(1.0, name, at, at + len(t.rstrip(".>/")))], name
    every = other.join(f"\n\n{t}\n\n" for t in standard_forms().values())
    assert [x[1] for x in licenses.find(every * 2, index)] == [*standard_forms()] * 2
    line = "This file is released under the MIT License, see LICENSE for details."
    assert licenses.find(line, index) == [(1.0, "MIT", line.index("released"), line.index(", see"))]
    assert licenses.find(f"{line} Data: licensed under CC BY-SA 4.0. Code is not.", index)[1][:2] == (1.0, "CC-BY-SA-4.0")


def test_best_run_against_all_runs():
    rnd = random.Random(5)
    index = licenses.Index([("A", "a b c d e f a c"), ("B", "b c a e"), ("B", "f e d c b a b")], 0.6)
    for _ in range(300):
        text = " ".join(rnd.choice("abcdefx") for _ in range(rnd.randint(2, 40)))
        words, all_runs = text.split(), []
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                got = index.best(" ".join(words[a:b]))
                if got:
                    all_runs.append((*got, 2 * a, 2 * b - 1))
        got = licenses.runs(text, index, [])
        if all_runs:
            assert max(x[0] for x in got) == max(x[0] for x in all_runs)
        for x in all_runs:  # each other one overlaps one as good
            assert any(y[0] >= x[0] and y[2] < x[3] and x[2] < y[3] for y in got)
        assert all(x[3] < y[2] for x, y in zip(got, got[1:], strict=False))
        assert all(index.best(text[a:b])[0] >= s for s, _, a, b in got)


def test_templates_from_files(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(500)}" for _ in range(6000)]
    (tmp_path / "Long-1.0.txt").write_text("\n\n".join(" ".join(words[i : i + 60]) for i in range(0, 6000, 60)))
    (tmp_path / "Short-2.0.txt").write_text("You may do as you like with this small work of ours.")
    templates = licenses.read_templates(spark, f"file://{tmp_path}")
    assert [n for n, _ in templates] == ["Long-1.0", "Short-2.0"]
    changed = [w if i % 80 else "changed" for i, w in enumerate(words)]
    texts = ["lead in\n\n" + "\n".join(" ".join(changed[i : i + 12]) for i in range(0, 6000, 12)) + "\n\ntail", "x. You may do as you like with this small work of ours. y", " ".join(words[:3000])]
    data = [(i, t, "en", "a", 0, *"wdky", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, data), templates=templates).collect()}
    assert [got[i].license for i in range(3)] == ["Long-1.0", "Short-2.0", None] and got[0].score > 0.9 and got[1].score > 0.9


def test_notices_of_one_family_are_told_apart():
    index = licenses.Index()
    for name, t in licenses.TEMPLATES:
        got = licenses.find(f"words before it\n\n{t}\n\nwords after it", index)
        assert max(got, key=lambda x: x[0])[:2] == (1.0, name)


def test_a_very_long_line():
    index = licenses.Index()
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    other = " ".join(f"word{i * i % 9973}" for i in range(200_000))
    assert [x[1] for x in licenses.find(f"{other} {mit} {other}", index)] == ["MIT"]


def test_least_start_of_spans_that_end_later():
    rnd = random.Random(5)
    for _ in range(200):
        spans = [(b, b - rnd.randint(0, 9)) for b in (rnd.randint(0, 40) for _ in range(rnd.randint(0, 12)))]
        tree, seen = licenses._Starts(spans), []
        for b, a in spans:
            tree.add(b, a)
            seen.append((b, a))
            for at in range(-1, 42):
                assert tree.least(at) == min((a for b, a in seen if b >= at), default=licenses._Starts.NONE)


def test_many_finds_in_one_text():
    index = licenses.Index()
    short = sorted((t for _, t in licenses.TEMPLATES), key=len)[:4]
    text = " and so ".join(short[i % 4] for i in range(3000))
    assert len(licenses.find(text, index)) == 3000
