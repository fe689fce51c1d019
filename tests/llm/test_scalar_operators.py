"""Operators that work row by row, against plain readings of their definitions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import frame, rows

from lectern.llm import bpe, dac, mixing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_quality_counts(spark):
    got = by_id(quality.judge(frame(spark)))
    assert sum(map(len, got.values())) == len(rows())
    for doc_id, text, *_ in rows():
        w = WORD.findall(text or "")
        grams = list(zip(w, w[1:], w[2:], strict=False))
        many = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + d for i, g in enumerate(grams) if g in many for d in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got[doc_id]], doc_id
        for r in got[doc_id]:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_quality_bad_host(spark):
    good, junk = " ".join(f"w{i}" for i in range(80)), "too short"
    data = [(i, good if i % 3 or i > 200 else junk, "en", "good", 0, *"wdky", 1) for i in range(300)]
    data += [(1000 + i, junk if i % 10 else good, "en", "bad", 0, *"wdky", 1) for i in range(200)]
    data += [(2000, good, "en", "tiny", 0, *"wdky", 1), (2001, junk, "en", "tiny2", 0, *"wdky", 1)]
    out = quality.keep_good(frame(spark, data))
    assert out.columns == frame(spark, data).columns
    assert {r.source for r in out.collect()} == {"good", "tiny"}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == 0
    assert bpe.digests(empty).count() == secrets.scan(empty).count() == secrets.redact(empty).count() == 0
    assert dac.read_digests(dac.write_shards(empty)).count() == 0
    assert mixing.mix(empty).count() == mixing.repeat_documents(empty).count() == 0


def test_bpe_equals_library_and_round_trips(spark):
    got = by_id(bpe.digests(frame(spark)))
    coder = bpe.encoding(*bpe.default_files())
    for doc_id, text, *_ in rows():
        ids = np.array(coder.encode_ordinary(text or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert want in [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[doc_id]]


def test_bpe_pieces_are_safe():
    files = bpe.default_files()
    text = "It's  a 1st\n\nline  of't text's  \n x" * 300 + "é" * 700 + " ," * 50
    whole = bpe.encode(text, *files)
    for size in (1, 7, 64, 1000):
        assert "".join(bpe.pieces(text, size)) == text
        assert (bpe.encode(text, *files, size=size) == whole).all()


def plain_base(text):
    found = []
    for kind, pattern, group, least in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ):
        found += [(m.start(), i, kind, m.end()) for i, m in ((("assign", "access", "hex").index(kind), m) for m in re.finditer(pattern, text)) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secrets(spark):
    got = by_id(secrets.scan(frame(spark)))
    for doc_id, text, *_ in rows():
        base = plain_base(text or "")
        r = next(r for r in got[doc_id] if r.base_sha256 == hashlib.sha256(base.encode()).hexdigest())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_secret_lexer():
    lit = lambda t: [t[a:b] for a, b, _ in secrets.literal_spans(t)]
    assert lit("db_pwd = 'hunter2-Zq91'") == ["hunter2-Zq91"]
    assert lit("x = 'Zq91hunter2-8812'\nconn.password = x") == ["Zq91hunter2-8812"]
    assert lit('{"private_key": "MIIEvQIBADANBgkq"}') == ["MIIEvQIBADANBgkq"]
    assert lit("<passphrase>q8Hd-22xx-Lm</passphrase>") == ["q8Hd-22xx-Lm"]
    assert lit("the key: answer is here. password = $ENV; token = example; secret: 'changeme'") == []
    assert secrets.masked("a token=abcdef123 b", secrets.all_spans("a token=abcdef123 b")[1]) == f"a {secrets.MASK} b"


LEXED = [
    ('pwd = "abc\\"Def9128-xyzQ"', ['abc\\"Def9128-xyzQ']),
    ('pwd = "Zq91-hun" + "ter2-8812"', ["Zq91-hun", "ter2-8812"]),
    ("pwd: |\n  Zq91-hun\n  ter2-8812\nx: y", ["Zq91-hun\n  ter2-8812"]),
    ("pwd: >-\n    Zq91hunter2-8812\n", ["Zq91hunter2-8812"]),
    ('<add key="pwd" value="Zq91hunter2-8812"/>', ["Zq91hunter2-8812"]),
    ('<string name="db_pwd">Zq91hunter2-8812</string>', ["Zq91hunter2-8812"]),
    ('pwd=os.environ.get("X", "Zq91hunter2-8812")', ["Zq91hunter2-8812"]),
    ('# pwd = "Zq91hunter2-8812"\n', ["Zq91hunter2-8812"]),
    ("# x = 'Zq91hunter2-8812'\npwd = x", []),
    ("x = 'Zq91hunter2-8812' # x = 'other'\npwd = x", ["Zq91hunter2-8812"]),
    ("x = 1 // db_pwd: Zq91hunter2-8812", ["Zq91hunter2-8812"]),
    ('cfg["pwd"] = "Zq91hunter2-8812"', ["Zq91hunter2-8812"]),
    ('pwd: str = "Zq91hunter2-8812"', ["Zq91hunter2-8812"]),
    ("if pwd == 'Zq91hunter2-8812': pass", ["Zq91hunter2-8812"]),
    ('credentials = {"user": "bob", "x": "Zq91hunter2-8812"}', ["Zq91hunter2-8812"]),
    ('passwords = [\n "Zq91hunter2-8812",\n\n "Xy91hunter2-8812"]', ["Zq91hunter2-8812", "Xy91hunter2-8812"]),
    ('a = "Zq91-hun"\nb = a + "ter2-8812"\nself.passphrase = b', ["Zq91-hun", "ter2-8812"]),
    ('class A:\n  X = "Zq91hunter2-8812"\nx.db_pwd = A.X', ["Zq91hunter2-8812"]),
    ('PWD = """Zq91hunter2\n-8812"""', ["Zq91hunter2\n-8812"]),
    ('pwd = (\n  "Zq91hunter2-"\n  "8812xy")', ["Zq91hunter2-", "8812xy"]),
    ("dbPwd := `Zq91hunter2-8812`", ["Zq91hunter2-8812"]),
    ('f(db_pwd="Zq91hunter2-8812", n=3)', ["Zq91hunter2-8812"]),
    ('curl -H "db_pwd: Zq91hunter2-8812" http://x', ["Zq91hunter2-8812"]),
    ("export DB_PWD=Zq91hunter2-8812", ["Zq91hunter2-8812"]),
    ("db_pwd = userInput", []), ("pwd = get_value(1)", []), ("pwd = cfg['x']", []), ("pwd == other", []), ("", []), ("<pwd/>", []),
]


@pytest.mark.parametrize(("text", "want"), LEXED)
def test_lexer_reads_syntax(text, want):
    for before, after in (("", ""), ("Some prose, it's here.\n\n", "\nand there"), ('x = {"a": [1, 2]}\n', "\n}\n")):
        whole = before + text + after
        assert [whole[a:b] for a, b, _ in secrets.literal_spans(whole)] == want


def test_literals_against_a_plain_generator():
    """Texts made of known pairs of a name and a literal, in every form: the spans are exactly the literals of sensitive names."""
    rnd = random.Random(12)
    forms = [
        "{n} = '{v}'", '{n}: "{v}"', '"{n}": "{v}",', "{n}={v}", "<{n}>{v}</{n}>", '<e key="{n}" value="{v}"/>', "--{n} {v}", 'c["{n}"] = "{v}"', "{n}: |\n    {v}", "tmp_x = '{v}'\no.{n} = tmp_x",
        "{n} = f('', '{v}')", "// {n} = '{v}'", "let {n}: string = `{v}`;", "{n} = [\n  '{v}'\n]",
    ]
    letters = "abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ"
    for _ in range(300):
        lines, want = [], []
        for _ in range(rnd.randint(1, 12)):
            value = "".join(rnd.choice(letters) for _ in range(12)) + str(rnd.randrange(1000, 9999)) + "-" + "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400)))
            name = rnd.choice(["db_pwd", "passphrase", "privateKey", "colour", "title", "count_x"])
            lines.append(rnd.choice(forms).format(n=name, v=value))
            want += [value] if name in ("db_pwd", "passphrase", "privateKey") else []
            lines.append(rnd.choice(["plain prose, no more", "", "it's 5 < 6", "x = 1"]))
        text = "\n".join(lines)
        assert [text[a:b] for a, b, _ in secrets.literal_spans(text)] == want, text


def test_secret_literals_of_any_length(spark):
    lit = lambda t: [t[a:b] for a, b, _ in secrets.literal_spans(t)]
    texts, wanted = [], []
    for n in (400, 401, 5000):
        value = ("Zq91hunterX2-" * n)[:n]
        for form in ("PRIVATE_KEY={}", 'private_key: "{}"', "{{'private_key': '{}'}}", "<passphrase>{}</passphrase>", "--db-pwd {}", "x = '{}'\nconn.pwd = x", '"doc": "' + "w " * 300 + "db_pwd = '{}'\""):
            texts.append("a b\n" + form.format(value) + "\nc d")
            wanted.append(value)
            assert lit(texts[-1]) == [value], (form, n)
    for blanks in (8, 9, 500):
        assert lit(f"db_pwd{' ' * blanks}={' ' * blanks}'hunter2-Zq91'") == lit(f'"db_pwd"{" " * blanks}:{" " * blanks}"hunter2-Zq91"') == ["hunter2-Zq91"]
    assert lit("n" * 200 + "_pwd = 'hunter2-Zq91'") == ["hunter2-Zq91"]
    assert lit(f"u=https://h/{'x' * 500}?a=1&db_pwd=hunter2-Zq91xy4821&b=2") == ["hunter2-Zq91xy4821"]
    data = frame(spark, [(i, t, *["a"] * 2, 0, *"wdky", 1) for i, t in enumerate(texts)])
    spans = {r.doc_id: r.spans.split(",") for r in secrets.scan(data).collect()}
    masked = {r.doc_id: r.text for r in secrets.redact(data).collect()}
    for i, (t, v) in enumerate(zip(texts, wanted, strict=True)):
        assert f"literal:{t.index(v)}:{t.index(v) + len(v)}" in spans[i]
        assert masked[i] == t.replace(v, secrets.MASK)
    for hard in ("pwd=" * 250_000, "a: " * 300_000, "a='" * 300_000, "<a>" * 300_000, "--a " * 250_000, "x" * 10**6, '"a"' + " " * 10**6, "pwd=?" * 200_000, "/*" * 300_000, "pwd=f(" * 150_000, "'''" * 300_000, "pwd:|\n" * 150_000, 'pwd="a"+' * 150_000, '{"pwd":' * 100_000):
        start = time.process_time()
        secrets.literal_spans(hard)
        assert time.process_time() - start < 20


def test_dac_file_format():
    rnd = np.random.default_rng(1)
    counts = np.array([0, 3, 5000, 1, 0, 700])
    ids = rnd.integers(0, 50_000, counts.sum()).astype("<u4")
    ids[::3] %= 256
    shard = dac.Shard(dac.pack(np.arange(6), counts, ids))
    assert (shard.ids() == ids).all() and shard.starts.tolist() == [0, *np.cumsum(counts)]
    assert all(shard[i] == ids[i] for i in [0, 1, 511, 512, 513, 4095, 4096, len(ids) - 1, *rnd.integers(0, len(ids), 200)])
    big = np.array([2**32 - 1, 0, 2**24, 70_000], "<u4")
    assert (dac.Shard(dac.pack(np.array([1]), np.array([4]), big)).ids() == big).all()


def test_dac_against_library(spark):
    got = dac.read_digests(dac.write_shards(frame(spark), shard_docs=40, shard_ids=2000)).collect()
    coder = dac.tokenizer(dac.default_path())
    want, seen = Counter(), {}
    for doc_id, text, *_ in rows():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    seen = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in seen] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    assert [r.start for r in seen] == [0, *np.cumsum([r.n_tokens for r in seen])[:-1]]


def test_word_encoder():
    import duckdb

    texts = [t for _, t, *_ in rows() if t]
    texts += ["e\u0301. x\u0301", "a_b c'd. 'tis (don't) \"It's\"", "<|startoftext|>x.<|endoftext|>. <|x|>", "ΑΣ. Σ İx ½x² 3a.b4", "\xa0a\u2003b\x1cc\x85d", "...'' ,., -", "ﬁ. Å Å 한글. \u1112\u1161\u11ab"]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    real = dac.tokenizer(dac.default_path())
    for memo in (8, 300, dac.MEMO):
        coder = dac.WordEncoder(dac.default_path(), memo=memo)
        some = texts if memo > 8 else texts[:60]
        want = [real.encode(text, add_special_tokens=False).ids for text in some]
        for piece in (dac.PIECE, 50):  # whole, and texts in pieces
            ids, counts = coder([*some, None], piece)
            assert ids.tolist() == sum(want, []) and counts.tolist() == [*map(len, want), 0]


def test_dac_of_null_and_repeated_ids_and_long_texts(spark):
    long = "lorem ipsum dolor " * 300_000
    data = [(None, f"text {i}", "en", "a", 0, *"wdky", 1) for i in range(60)] + [(7, f"text {i % 50}", "en", "a", 0, *"wdky", 1) for i in range(90)] + [(9, long, "en", "a", 0, *"wdky", 1)]
    shards = dac.write_shards(frame(spark, data), shard_docs=10, shard_ids=1000)
    sizes = [r.documents for r in shards.collect()]
    assert len(sizes) > 8 and sum(sizes) == 151
    got = dac.read_digests(shards).collect()
    n = len(dac.tokenizer(dac.default_path()).encode("lorem ipsum dolor", add_special_tokens=False).ids)
    assert [r.n_tokens for r in got if r.doc_id == 9] == [300_000 * n + 1]
    assert sorted(r.start for r in got)[-1] == sum(r.n_tokens for r in got) - 300_000 * n - 1
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 60 + [7] * 90 + [9]


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Shares the excess again until no source is above its cap."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def test_mixing_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 20)
    rnd = random.Random(8)
    many = {f"host{rnd.randrange(10**6)}é"[: rnd.randint(5, 11)]: rnd.choice([0, 1, 10, 10**6]) * rnd.randint(1, 9) for _ in range(150)}
    for sizes in ({"a": 100, "b": 100, "c": 100}, {None: 10}, {"a": 0, "b": 10}, {"a": 0, None: 0}, {"z": 7, "a": 1, None: 1000, "b": 5}, many):
        got = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")).collect()
        want = plain_targets(sizes)
        assert len(got) == len(sizes) and all(abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source]) for r in got)
    assert plain_targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": 2 * 250 / 3, "c": 250 / 3}


def test_mixing_keeps_every_row_apart(spark):
    data = [(None, f"null id {i} and words", "en", "a", i, *"wdky", 1) for i in range(20)] + [(5, "one two three", "en", "a", 0, *"wdky", 1)]
    data += [(7, "same text here " * (1 + i % 3), "en", None, i, *"wdky", 1) for i in range(30)] + [(8, "equal", "en", "b", 0, *"wdky", 1)] * 9
    docs = frame(spark, data)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source, r.size] += r.copies
    out = mixing.repeat_documents(docs).collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out) == +copies
    assert max(Counter(map(tuple, (r for r in out if r.doc_id != 8))).values()) <= 2
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.repeat_documents(docs.repartition(5)).collect()), key=repr)


def test_mixing(spark):
    docs = frame(spark)
    first, again = (sorted(map(str, mixing.mix(d, bucket=8, fan=3).collect())) for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(rows())
    got = mixing.mix(docs, bucket=8, fan=3).collect()
    sizes = Counter()
    for doc_id, text, _, source, *_ in rows():
        sizes[source] += len(WORD.findall(text or ""))
    aim, taken = plain_targets(dict(sizes)), Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - aim[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s, t in aim.items():
        assert abs(taken[s] - t) <= max(r.size for r in got if r.source == s)
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_pivot_keeps_words_and_expectation():
    for p, a, q, b in ((0.3, 10, 0.6, 7), (0.9, 100, 0.9, 3), (0.5, 4, 0.5, 4), (0.1, 5, 0.2, 500)):
        ends = [mixing._pair(p, a, q, b, u) for u in np.linspace(0, 0.999999, 20001)]
        assert all(abs(x * a + y * b - p * a - q * b) < 1e-9 and (x in (0, 1) or y in (0, 1)) for x, y in ends)
        assert abs(np.mean([x for x, _ in ends]) - p) < 1e-3


CHAINS = [
    ('k = "Zq91hunter2-8812"\n' + "k = k + k\n" * 27 + "pwd = k", ["Zq91hunter2-8812"]),
    ('k = "Zq91hunter2-8812"\n' + "k = k + k\n" * 2000 + "pwd = k", ["Zq91hunter2-8812"]),
    ('n0 = "Zq91hunter2-8812"\n' + "".join(f'n{i} = n{i - 1} + "x{i}"\n' for i in range(1, 20_000)) + "pwd = n19999", ["Zq91hunter2-8812", *(f"x{i}" for i in range(1, 20_000))]),
    ('pwd0 = "Zq91hunter2-8812"\n' + "".join(f"pwd{i} = pwd{i - 1} + pwd{i - 1}\n" for i in range(1, 20_000)), ["Zq91hunter2-8812"]),
    ('pwd0 = "a b"\n' + "".join(f'pwd{i} = pwd{i - 1} + "a b"\n' for i in range(1, 20_000)), []),
    ("a = '-----BEGIN PRIV'\nb = 'ATE '\nc = 'KEY-----x'\npwd = a + b + c", ["-----BEGIN PRIV", "ATE ", "KEY-----x"]),
]


@pytest.mark.parametrize("case", range(len(CHAINS)))
def test_names_bound_from_names_cost_their_own_lines(case):
    text, want = CHAINS[case]
    assert [text[a:b] for a, b, _ in secrets.literal_spans(text)] == want


def test_joined_literals_are_judged_as_one_text():
    """Facts and entropy of values built from shared parts are those of the joined text."""
    rnd = random.Random(8)
    for _ in range(300):
        values = [(secrets._Value((i, i + 1), t), t) for i, t in enumerate("".join(rnd.choice("aB3-é $") for _ in range(rnd.randint(0, 9))) for _ in range(4))]
        for _ in range(6):
            some = [rnd.choice(values) for _ in range(rnd.randint(1, 3))]
            values.append((secrets._Value(parts=tuple(v for v, _ in some)), "".join(t for _, t in some)))
        for v, t in values:
            assert v.known() == secrets._Facts.of(t)
            n = Counter(t)
            assert not t or abs(v.entropy() + sum(k / len(t) * math.log2(k / len(t)) for k in n.values())) < 1e-9


def test_self_referring_names_in_scan_redact_and_pipeline(spark):
    import corpus_pipeline

    text = CHAINS[1][0] + "\n" + " ".join(f"word{i}" for i in range(80))
    docs = frame(spark, [(1, text, "en", "a", len(text), *"wdky", 1)])
    assert secrets.scan(docs).first().spans == f"literal:{text.index('Zq')}:{text.index('Zq') + 16}"
    assert secrets.redact(docs).first().text == text.replace("Zq91hunter2-8812", secrets.MASK)
    for _, f in corpus_pipeline.STAGES[1:-1]:
        docs = f(spark, docs, "")
    assert secrets.MASK in docs.first().text


def test_dac_keeps_every_doc_id(spark):
    ids = [None, -(1 << 63), -(1 << 63) + 1, 0, (1 << 63) - 1]
    docs = frame(spark, [(i, "some words", "en", "a", 1, *"wdky", 1) for i in ids])
    got = dac.read_digests(dac.write_shards(docs)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == ids
