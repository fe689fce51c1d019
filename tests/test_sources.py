"""Sources, sinks, folds and model answers, on small inputs with known results."""

import io
import itertools
import json
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import answers, models
from lectern.functions import text as T
from lectern.functions.scheduling import initial, review
from lectern.operators import assets, structure
from lectern.sinks import export
from lectern.sources import documents, web

MARKDOWN = "# One\n\nFirst para-\ngraph here.\n\n```python\n# not a heading\n\nx = 1\n```\n\n![pic](a/b.png)\n\n# Two\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter table\n"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_encodings(spark):
    text = "自学系统 text"
    data = [text.encode("utf-8"), text.encode("utf-8-sig"), text.encode("gbk"), text.encode("gb18030"), b"", None]
    rows = spark.createDataFrame([Row(i=i, content=None if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, content binary")
    assert [r.t for r in rows.select("i", documents.decoded("content").alias("t")).orderBy("i").collect()] == [text, text, text, text, "", None]


def test_markdown(spark):
    got = documents.parse_markdown(spark.createDataFrame([("d", MARKDOWN), ("e", None)], "doc_id string, text string")).orderBy("ord").collect()
    assert [(r.chapter_id, r.title, r.id, r.type) for r in got] == [
        ("ch_001", "One", "p_001_0001", "text"), ("ch_001", "One", "p_001_0002", "text"), ("ch_001", "One", "p_001_0003", "code"), ("ch_001", "One", "p_001_0004", "image"),
        ("ch_002", "Two", "p_002_0005", "text"), ("ch_002", "Two", "p_002_0006", "table"), ("ch_002", "Two", "p_002_0007", "text"),
    ]
    assert got[1].english == "First paragraph here." and got[2].english.endswith("x = 1\n```") and "\n\n" in got[2].english
    assert got[3].image_url == "a/b.png" and got[0].is_heading and [r.status for r in got] == ["pending", "pending", "completed", "completed", "pending", "pending", "pending"]


def test_plain_text(spark):
    text = "Chapter 1 Start\n\nSome text\nover lines.\n\nChapter 2 End\n\nMore."
    many = "\n\n".join(f"para number {i} with words" for i in range(100))
    rows = documents.parse_text(spark.createDataFrame([("a", text), ("b", many), ("c", "one\n\ntwo"), ("z", "第一章 开始\r\n\r\n这是一个中文段落。")], "doc_id string, text string")).orderBy("doc_id", "ord").collect()
    by = {k: list(v) for k, v in itertools.groupby(rows, lambda r: r.doc_id)}
    assert [(r.title, r.english, r.is_heading) for r in by["a"]] == [("Chapter 1 Start", "Chapter 1 Start", True), ("Chapter 1 Start", "Some text over lines.", False), ("Chapter 2 End", "Chapter 2 End", True), ("Chapter 2 End", "More.", False)]
    assert sorted({(r.chapter_no, r.title) for r in by["b"]}) == [(1, "Part 1 (Paras 1-45)"), (2, "Part 2 (Paras 46-90)"), (3, "Part 3 (Paras 91-100)")]
    assert {r.title for r in by["c"]} == {"Document Body"} and [(r.lang, r.status) for r in by["z"]] == [("zh", "completed")] * 2


def test_read_files(spark, tmp_path):
    (tmp_path / "a.md").write_text(MARKDOWN)
    (tmp_path / "b.txt").write_bytes("Chapter 1 X\n\n正文内容在这里".encode("gbk"))
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = documents.read_text_documents(spark, f"file://{tmp_path}").groupBy("doc_id").count().collect()
    assert sorted((r["doc_id"].rsplit("/", 1)[1], r["count"]) for r in got) == [("a.md", 7), ("b.txt", 2)]


def test_epub(spark):
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="text/a.xhtml"/><item id="b" href="text/b.xhtml"/><item id="x" href="gone.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="x"/><itemref idref="a"/></spine></package>"""
    ncx = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Beta</text></navLabel><content src="text/b.xhtml#top"/></navPoint></navMap></ncx>"""
    data = zipped({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>', "OEBPS/c.opf": opf, "OEBPS/toc.ncx": ncx, "OEBPS/text/a.xhtml": "<html><body><h1>A</h1><p>one</p></body></html>", "OEBPS/text/b.xhtml": "<html><body><p>b <img src='../i/p%20q.png'/></p></body></html>"})
    got = documents.read_epub(spark.createDataFrame([("x.epub", bytearray(data))], "path string, content binary")).orderBy("chapter_no").collect()
    assert [(r.title, r.markdown) for r in got] == [("Beta", "![image](./images/p q.png)\n\nb"), ("Chapter 2", "# A\n\none")]


def test_folders(spark):
    by_summary = zipped({"d/SUMMARY.md": "* [Second](b.md#x)\n* [First](docs/a.md)\n* [Gone](c.md)", "d/b.md": "B", "d/docs/a.md": "A"})
    by_nav = zipped({"mkdocs.yml": "site: x\nnav:\n  - 'Home': 'index.md'\n  - guide/two.md\nextra: 1", "docs/index.md": "I", "docs/guide/two.md": "T"})
    by_name = zipped({"10.md": "ten", "2.md": "two", "README.md": "r", ".hidden/x.md": "no"})
    files = spark.createDataFrame([("s", bytearray(by_summary)), ("n", bytearray(by_nav)), ("z", bytearray(by_name))], "path string, content binary")
    got = documents.read_folders(files).orderBy("path", "chapter_no").collect()
    assert [(r.path, r.title, r.markdown) for r in got] == [("n", "Home", "I"), ("n", "two", "T"), ("s", "Second", "B"), ("s", "First", "A"), ("z", "README", "r"), ("z", "2", "two"), ("z", "10", "ten")]


def test_workbook(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c></row><row r="3"><c r="B3" s="1"><v>46316</v></c><c r="C3"><v>2.5</v></c><c r="D3" t="b"><v>1</v></c></row><row r="5"><c r="B5" t="inlineStr"><is><t>a&lt;b</t></is></c></row></sheetData><mergeCells><mergeCell ref="B2:C2"/><mergeCell ref="B5:B6"/></mergeCells></worksheet>'
    data = zipped({
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Title</t></si></sst>", "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": sheet, "xl/worksheets/s2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
    })
    got = documents.read_workbooks(spark.createDataFrame([("w.xlsx", bytearray(data))], "path string, content binary")).collect()
    assert [(r.title, r.table) for r in got] == [("Data", '<table><tr><th colspan="2">Title</th><th></th></tr><tr><td>2026-10-21</td><td>2.5</td><td>TRUE</td></tr><tr><td rowspan="2">a&lt;b</td><td></td><td></td></tr><tr><td></td><td></td></tr></table>')]
    assert [documents.cell_text(v) for v in (1234567.5, 3.0, None, False, " x ")] == ["1.23457e+06", "3", "", "FALSE", "x"]


def test_archive_entries_and_scanned_pages(spark):
    files = spark.createDataFrame([("z", bytearray(zipped({"a/": "", "a/X.png": "1", "b/x.png": "2"})))], "path string, content binary")
    entries = documents.archive_entries(files)
    assert sorted(r.entry for r in entries.collect()) == ["a/X.png", "b/x.png"]
    assert assets.local_files(entries.select(F.col("entry").alias("path"))).first()[:] == ("x.png", "b/x.png")
    docs = spark.createDataFrame([("d", 5), ("e", 1)], "doc_id string, total_pages int")
    toc = spark.createDataFrame([("d", 1, "A", 2), ("d", 2, "sub", 3), ("d", 1, "B", 4)], "doc_id string, level int, title string, page int")
    got = documents.scanned_paragraphs(docs, toc).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.chapter_no, r.title, r.id) for r in got] == [("d", 0, "Introduction", "p_000_0001"), ("d", 1, "A", "p_001_0002"), ("d", 1, "A", "p_001_0003"), ("d", 2, "B", "p_002_0004"), ("d", 2, "B", "p_002_0005"), ("e", 0, "Introduction", "p_000_0001")]
    asks = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, t int")
    assert sorted((r.k, r.t) for r in assets.single_flight(asks, "k", "t").collect()) == [("a", 1), ("b", 5)]


def test_web(spark):
    html = "<html><head><title>T - Site</title><script>if (a</p>) {}</script></head><body><nav><a href='/a/'>A</a><a href='b?x=1'> B  b </a><a href='#t'>no</a><a href='http://other/x'>O</a><a href='/a#z'>A again</a></nav><article><h1>Head¶</h1><p>one<p>two<ul><li>x<li>y</ul><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table><pre>code</pre><blockquote>q</blockquote></article></body></html>"
    pages = spark.createDataFrame([(1, "http://h.org/s/b", html)], "page_id int, url string, html string")
    assert pages.select(web.page_title(F.col("html")), web.site_title(F.col("html"))).first()[:] == ("Head", "T - Site")
    assert pages.select(web.to_markdown("html")).first()[0] == "# Head¶\n\none\n\ntwo\n\n- x\n- y\n\n| h | i |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode\n```\n\n> q"
    assert [(r.title, r.url, r.is_current) for r in web.sidebar(pages).orderBy("ord").collect()] == [("A", "http://h.org/a", False), ("B b", "http://h.org/s/b", True)]
    chosen = spark.createDataFrame([(0, "", "http://h.org/none"), (1, "Mine", "http://h.org/s/b")], "index int, title string, url string")
    assert [(r['index'], r.title, r.fetch_success) for r in web.series(pages, chosen).collect()] == [(0, None, False), (1, "Mine", True)]


def test_assets(spark):
    p = spark.createDataFrame([("d", "c1", 0, '<img src="a/X%20y.png"> ![t](b.jpg "title") ![t](b.jpg)', None), ("d", "c2", 1, "<video src='v.mp4'>", "![q](b.jpg)")], "doc_id string, chapter_id string, ord int, english string, chinese string")
    refs = assets.references(p)
    assert sorted((r.raw, r.kind, r.chapter_id) for r in refs.collect()) == [("a/X%20y.png", "html_img", "c1"), ("b.jpg", "md_img", "c1"), ("v.mp4", "media", "c2")]
    local = assets.local_files(spark.createDataFrame([("img/x y.png",), (".git/b.jpg",)], "path string"))
    got = assets.match(refs, local, spark.createDataFrame([("b.jpg", "src/b.jpg")], "key string, path string"))
    assert {r.raw: r.path for r in got.collect()} == {"a/X%20y.png": "img/x y.png", "b.jpg": "src/b.jpg", "v.mp4": None}
    out = assets.rewrite(p, got.where("matched").select("doc_id", "raw", "path")).orderBy("ord").collect()
    assert out[0].english == '<img src="img/x y.png"> ![t](src/b.jpg "title") ![t](src/b.jpg)' and out[1].chinese == "![q](src/b.jpg)"


@pytest.mark.parametrize(("rating", "state", "want"), [
    (3, (0, 0, 2.5, 0), (1, 0, "review", 2.5, 1)), (4, (1, 0, 2.5, 1), (2, 0, "mastered", 2.6, 6)), (3, (2, 0, 2.6, 6), (3, 0, "review", 2.6, 16)), (1, (3, 0, 2.6, 16), (0, 1, "learning", 2.06, 0)), (1, (0, 0, 1.3, 0), (0, 1, "learning", 1.3, 0)),
])
def test_sm2_table(spark, rating, state, want):
    s = initial().withField("reps", F.lit(state[0])).withField("lapses", F.lit(state[1])).withField("ease_factor", F.lit(state[2])).withField("interval_days", F.lit(state[3]).cast("long"))
    r = spark.range(1).select(review(s, F.lit(rating), F.lit(0)).alias("s")).select("s.*").first()
    assert (r.reps, r.lapses, r.state, r.ease_factor, r.interval_days) == want and r.next_review == (600 if want[2] == "learning" else want[4] * 86400)


def test_translation_answers():
    t = answers.translation_of
    assert t("> 一行\n> 二行") == "一行二行"
    assert t("<think>想</think>译文：你好 world") == "你好 world"
    assert t("前文参考：旧\n---\n> 新的译文") == "新的译文"
    assert t("a\n---\n> 甲\n\n> 乙") == "a\n\n甲\n\n乙"
    assert t("【待翻译段落】：目标文") == "目标文" and t(" ") == "" and t("plain english") == "plain english"


def test_flashcard_blocks():
    text = "intro\n:::flashcard\ntype: cloze\nfront: The {{x}} is\nmore\nback: y\ntags: #a，b\n:::\nmid\n```flashcard\n问题：Q\n答案：A\n```\ntail"
    got = answers.segments_of(text)
    assert [s["kind"] for s in got] == ["markdown", "flashcard", "markdown", "flashcard", "markdown"]
    assert got[1]["card"] == {"type": "cloze", "front": "The {{x}} is\nmore", "back": "y", "tags": ["a", "b"]} and got[3]["card"]["front"] == "Q" and got[3]["card_index"] == 1
    assert answers.parse_card("just text")["front"] == "just text" and answers.segments_of("") == []


def test_anki_package(spark):
    cards = spark.createDataFrame([("d", "1", "qa", "a<b", "x\n\ny", ["t u"]), ("d", "2", "cloze", "{{one}} {{two}}", "", [])], "doc_id string, id string, type string, front string, back string, tags array<string>").withColumn("stats", initial())
    row = export.anki_packages(cards, 1_700_000_000, number_clozes=True).collect()[0]
    with zipfile.ZipFile(io.BytesIO(row.apkg)) as z:
        db = sqlite3.connect(":memory:")
        db.deserialize(z.read("collection.anki2"))
    assert db.execute("select count(*) from cards").fetchone()[0] == db.execute("select count(*) from notes").fetchone()[0] == 2
    assert [r[0].split("\x1f")[0] for r in db.execute("select flds from notes order by id")] == ["<p>a&lt;b</p>", "<p>{{c1::one}} {{c2::two}}</p>"]
    assert {t for (t,) in db.execute("select name from sqlite_master where type='table'")} == {"col", "notes", "cards", "revlog", "graves"}


def test_exports(spark):
    paras = spark.createDataFrame([("d", "c", 0, "text", "Hello", "你好\n二"), ("d", "c", 1, "image", "![x](./images/a.png)", "")], "doc_id string, chapter_id string, ord int, type string, english string, chinese string")
    chapters = spark.createDataFrame([("d", "c", 0, "T", [("h", "n\nm")])], "doc_id string, chapter_id string, ch_ord int, title string, header_notes array<struct<title:string,content:string>>")
    docs, cards = spark.createDataFrame([("d", "F & G")], "doc_id string, filename string"), spark.createDataFrame([("d", "1", "q")], "doc_id string, id string, front string")
    md = export.render_chapters(paras, chapters).first().markdown
    assert md == f"# T\n\n{export.HEADER_LABEL}> **h**\n> n\n> m\n\n---\n\nHello\n\n> 你好\n> 二\n\n---\n\n![x](./images/a.png)\n\n---\n\n"
    assert "](images/a.png)" in export.export("markdown", paras, chapters, docs, cards).first().markdown
    assert "](./images/a.png)" in export.export("raw_markdown", paras, chapters, docs, cards).first().markdown
    with zipfile.ZipFile(io.BytesIO(export.export("markdown_zip", paras, chapters, docs, cards).first().archive)) as z:
        assert z.read("document.md").decode() == md
    assert "F &amp; G" in export.export("html", paras, chapters, docs, cards).first().html
    assert json.loads(export.export("flashcards_json", paras, chapters, docs, cards).first().payload) == [{"id": "1", "front": "q"}]
    with zipfile.ZipFile(io.BytesIO(export.export("site_zip", paras, chapters, docs, cards).first().archive)) as z:
        assert z.namelist() == ["index.html", "flashcards.json"]
    old = spark.createDataFrame([("d", 1), ("e", 2)], "doc_id string, n int")
    assert sorted(r[:] for r in export.patched_manifest(old, spark.createDataFrame([("d", 9)], "doc_id string, n int")).collect()) == [("d", 9), ("e", 2)]
    images = spark.createDataFrame([("d", "a.png", bytearray(b"\1"))], "doc_id string, name string, content binary")
    assert "](data:image/png;base64,AQ==)" in export.inline_images(export.full_markdown(export.render_chapters(paras, chapters)), images).first().markdown
    with pytest.raises(ValueError):
        export.export("pdf", paras, chapters, docs, cards)


def test_write_table_replaces_documents(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    export.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int"), path)
    export.write_table(spark.createDataFrame([("b", 3)], "doc_id string, v int"), path)
    assert sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_models(spark):
    models.register_provider("fails", lambda p: (_ for _ in ()).throw(ValueError("busy")))
    rows = spark.createDataFrame([("p",), (None,)], "p string")
    assert [r[0] for r in rows.select(models.call_model(F.col("p"), "fails")).collect()] == ["[翻译调用异常: busy]", None]
    assert rows.select(models.call_model(F.col("p"))).first()[0] == models.stub("p") and "stub" in models.providers()
    tried = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    models.register_provider("second_try", lambda p, seen=[]: f"ok {p}" if p in seen else seen.append(p) or 1 / 0)  # noqa: B006
    assert [r[0] for r in tried.select(models.call_model(F.col("p"), "second_try", workers=2, tries=2)).collect()] == ["ok a", "ok b"]
    models.register_functions(spark)
    assert spark.sql("select parse_translation('> 好')").first()[0] == "好"


def test_chapter_partition():
    titles = [("A", 0, None), ("B", 2, None), ("C", 4, 8), ("D", 4, None)]
    scores = {(1, 4): 0.9, (3, 9): 0.95}
    got = structure.choose_splits(10, titles, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4], lambda k, i, on: scores.get((k, i), 0.0))
    assert got == [(0, "A"), (4, "B"), (8, "C")]
    assert structure.choose_splits(3, [], [0, 0, 0], None) == []


def test_repair_equals_plain_reading(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "bc", "-", "\n", " ", "\t", "\n\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]

    def plain(t):
        paras = []
        for p in t.split("\n\n"):
            out = ""
            for s in filter(None, (x.strip() for x in p.split("\n"))):
                out = s if not out else out[:-1] + s if out.endswith("-") else f"{out} {s}"
            paras.append(out)
        import re

        return re.sub("[ \t]+", " ", "\n\n".join(paras)).strip()

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.repaired(F.col("t")).alias("r")).orderBy("i").collect()
    bad = [(t, r.r, plain(t)) for t, r in zip(texts, rows, strict=True) if r.r != plain(t)]
    assert not bad, bad[:3]


def test_schemas(spark):
    for ddl in (schemas.DOCUMENTS, schemas.CHAPTERS, schemas.PARAGRAPHS, schemas.CARDS, schemas.CHAT_MESSAGES, schemas.DIGESTS):
        assert spark.createDataFrame([], ddl).columns
    row = schemas.normalize(spark.createDataFrame([(None, None, "src")], "english string, status string, source_text string"), "paragraphs").first()
    assert (row.english, row.status) == ("src", "pending")
    assert [r.type for r in schemas.normalize(spark.createDataFrame([("x",), ("cloze",)], "type string"), "cards").collect()] == ["qa", "cloze"]


def test_intervals_of_long_runs_of_top_ratings(spark):
    from pyspark.sql import functions as F

    from lectern.functions.scheduling import MOST_DAYS, replay

    log = spark.range(200).select(F.lit(1).alias("card"), F.col("id").alias("n"), F.lit(4).alias("rating"), F.lit(1_700_000_000).alias("at"))
    s = replay(log, "card", ["n"], "rating", "at").collect()[0].stats
    assert (s.reps, s.state, s.interval_days, s.next_review) == (200, "mastered", MOST_DAYS, 1_700_000_000 + MOST_DAYS * 86400)
