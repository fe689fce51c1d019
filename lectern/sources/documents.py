"""Reading documents: encoded text, Markdown, plain text, EPUB, workbooks, folders of Markdown in archives.

Files come as rows (path, content) from Spark's binaryFile reader, so any store that Spark reads serves, and each file is one row: work
is spread over files. Formats are decoded in Python (zipfile, ElementTree); rules on text are columns where they can be.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from lectern.functions import text as T
from lectern.operators import structure as S

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "cp936", "big5", "latin-1")


def decode_bytes(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


@F.pandas_udf(ty.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of encoded bytes; Spark's own decoder knows neither GB18030 nor Big5."""
    return content.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of files, in all folders below."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def file_type(path: Column) -> Column:
    """Kind of document by extension; unknown ones are 'unsupported'."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext == "pdf", "pdf").when(ext.isin("txt", "text", "log"), "txt").when(ext.isin("md", "markdown"), "md").when(ext == "epub", "epub")
        .when(ext.isin("xlsx", "xlsm"), "excel").when(ext == "zip", "folder").when(ext.isin("docx", "doc"), "docx").when(ext.isin("pptx", "ppt"), "pptx")
        .when(ext.isin("png", "jpg", "jpeg", "webp", "bmp"), "image").otherwise("unsupported")
    )


def page_count(kind: Column, lines: Column, paragraphs: Column, pages: Column) -> Column:
    """Pages of a document: 50 lines of text or 22 paragraphs of a word file to a page; one for images."""
    up = lambda x, n: F.greatest(F.lit(1), F.ceil(x / n)).cast("int")
    return F.when(kind.isin("txt", "md"), up(lines, 50)).when(kind == "docx", up(paragraphs, 22)).when(kind == "image", 1).otherwise(F.coalesce(pages, F.lit(1)))


# --- Markdown ---

_HEADING = re.compile(r"#{1,6}\s+")
_IMAGE = re.compile(r"!\[(.*?)\]\((.*?)\)$")


def markdown_blocks(text: str) -> list[tuple[str, bool]]:
    """(text, is_code) of the raw blocks: headings, images, tables, fences and runs of other lines.

    A fence runs to a line that starts with the same three characters, or to the end of the text; what it holds is left alone.
    """
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    fence = ""

    def close(code: bool = False) -> None:
        body = "\n".join(held).strip()
        if body:
            out.append((body, code))
        held.clear()

    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        s = line.strip()
        if fence:
            held.append(line)
            if s.startswith(fence):
                close(True)
                fence = ""
        elif s.startswith(("```", "~~~")):
            close()
            fence = s[:3]
            held.append(line)
        elif not s:
            close()
        elif _HEADING.match(s) or _IMAGE.match(s):
            close()
            out.append((s, False))
        else:
            if held and s.startswith("|") != held[-1].strip().startswith("|"):
                close()
            held.append(line)
    close(bool(fence))
    return out


@F.udf(ty.ArrayType(ty.StructType([ty.StructField("text", ty.StringType()), ty.StructField("is_code", ty.BooleanType())])), useArrow=False)
def raw_blocks(text: str | None) -> list[tuple[str, bool]]:
    """Rows go to Python by the hundred: in Arrow's batches of 10,000, whole texts and their blocks would stand there at once."""
    return markdown_blocks(text or "")


def _finish(rows: DataFrame, doc: str, text: Column, lang: Column, is_code: Column, is_image: Column, heading: Column, table: Column) -> DataFrame:
    """Type, text, status and flags of paragraphs."""
    kind = F.when(is_code, "code").when(is_image, "image").when(table & ~heading, "table").otherwise("text")
    clean = F.when((lang == "en") & (kind == "text") & ~heading, T.repaired(text)).otherwise(text)
    still = (lang == "zh") | T.mostly_target(clean) | is_code | is_image
    return rows.withColumns({
        "type": kind, "english": clean, "chinese": F.lit(""), "page": F.lit(1), "status": F.when(still, "completed").otherwise("pending"), "no_translate": still,
        "image_url": F.when(is_image & ~is_code, F.regexp_extract(text, r"^!\[.*?\]\((.*?)\)$", 1)).otherwise(""), "is_heading": heading & ~is_code,
    })


PARAGRAPH_COLUMNS = ["chapter_no", "chapter_id", "title", "ord", "id", "page", "type", "english", "chinese", "status", "no_translate", "image_url", "is_heading", "lang"]


def parse_markdown(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs of Markdown documents, with chapter_no, chapter_id and title. A document without blocks has no rows."""
    told = docs.select(doc, T.detect_language(F.coalesce(text, F.lit(""))).alias("lang"), raw_blocks(F.col(text)).alias("_blocks"))  # beside an explode, the language would be told for each block anew; a plain one finds the blocks twice
    blocks = told.select(doc, "lang", F.posexplode_outer("_blocks").alias("ord", "b")).where("ord is not null").select(doc, "lang", "ord", "b.text", "b.is_code")
    rows = S.with_heading_rule(blocks, [doc], "text", F.col("is_code"))
    opens = ~F.col("is_code") & (
        F.when(F.col("rule") == "#", F.col("text").rlike(r"^#\s+.+$")).when(F.col("rule") == "#{1,2}", F.col("text").rlike(r"^#{1,2}\s+.+$"))
        .when(F.col("rule") == "##", F.col("text").rlike(r"^##\s+.+$")).when(F.col("rule") == "###", F.col("text").rlike(r"^###\s+.+$")).otherwise(False)
    )
    return _chaptered(rows, doc, opens, T.strip(F.regexp_extract("text", r"^#+\s+(.+)$", 1)), "引言")


def _chaptered(rows: DataFrame, doc: str, opens: Column, own_title: Column, zh_intro: str) -> DataFrame:
    from pyspark.sql import Window

    led = S.chapter_ids(rows.withColumn("_opens", opens).withColumn("_title", own_title), [doc], ["ord"], F.col("_opens"))
    per_chapter = Window.partitionBy(doc, "chapter_no").orderBy("ord")
    one = F.max("chapter_no").over(Window.partitionBy(doc)) == 1
    head = F.first(F.when(F.col("_opens"), F.col("_title")), ignorenulls=False).over(per_chapter)
    zh = F.col("lang") == "zh"
    title = F.coalesce(head, F.when(one, F.when(zh, "文档正文").otherwise("Document Body")).otherwise(F.when(zh, f"导读 / {zh_intro}").otherwise("Introduction")))
    named = S.paragraph_ids(led.withColumn("title", title), [doc], ["ord"])
    t = F.col("text")
    code = F.col("is_code") | t.startswith("```")
    out = _finish(named, doc, t, F.col("lang"), code, t.rlike(r"^!\[.*?\]\(.*?\)$") & ~code, t.startswith("#"), t.startswith("|"))
    return out.select(doc, *PARAGRAPH_COLUMNS)


def parse_text(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs of plain-text documents, parted by blank lines; chapters start at headings (first lines of up to 100 characters), or
    after every 45 paragraphs of a document of more than 50 without headings. A document without paragraphs has no rows."""
    from pyspark.sql import Window

    x = F.coalesce(text, F.lit(""))
    told = docs.select(doc, T.detect_language(x).alias("lang"), T.blank_line_paragraphs(x).alias("_paragraphs"))  # beside an explode, the language would be told for each paragraph anew
    rows = told.select(doc, "lang", F.posexplode_outer("_paragraphs").alias("ord", "text")).where("ord is not null")  # a plain explode finds the array twice, to filter by its size
    first = T.strip(F.split("text", "\n", 2)[0])
    w = Window.partitionBy(doc)
    rows = rows.withColumn("_first", first).withColumn("_head", T.is_heading(first, "outline"))
    rows = rows.withColumn("_opens", F.col("_head") & (F.length("_first") <= 100))
    rows = rows.withColumn("_any", F.max(F.col("_opens").cast("int")).over(w) == 1).withColumn("_total", F.count("*").over(w))
    by_heading = S.chapter_ids(rows, [doc], ["ord"], F.col("_opens"))
    batched = F.when(F.col("_total") > S.LONG_DOCUMENT, F.floor(F.col("ord") / S.BATCH) + 1).otherwise(1)
    led = by_heading.withColumn("chapter_no", F.when(F.col("_any"), F.col("chapter_no")).otherwise(batched).cast("int")).withColumn("chapter_id", F.format_string("ch_%03d", "chapter_no"))
    head = F.first(F.when(F.col("_opens"), F.col("_first"))).over(Window.partitionBy(doc, "chapter_no").orderBy("ord"))
    zh, start = F.col("lang") == "zh", (F.col("chapter_no") - 1) * S.BATCH + 1
    end = F.least(F.col("chapter_no") * S.BATCH, F.col("_total"))
    part = F.when(zh, F.format_string("第 %d 部分 (%d~%d段)", "chapter_no", start, end)).otherwise(F.format_string("Part %d (Paras %d-%d)", "chapter_no", start, end))
    title = F.when(F.col("_any"), F.coalesce(head, F.when(zh, "导读 / 前言").otherwise("Introduction"))).when(F.col("_total") > S.LONG_DOCUMENT, part).otherwise(F.when(zh, "文档正文").otherwise("Document Body"))
    named = S.paragraph_ids(led.withColumn("title", title), [doc], ["ord"])
    no = F.lit(False)
    t = F.col("text")
    clean = F.when(F.col("lang") == "en", T.repaired(t)).otherwise(t)
    still = (F.col("lang") == "zh") | T.mostly_target(clean)
    out = named.withColumns({
        "page": F.lit(1), "type": F.lit("text"), "english": clean, "chinese": F.lit(""), "status": F.when(still, "completed").otherwise("pending"),
        "no_translate": still, "image_url": F.lit(""), "is_heading": F.when(F.col("_any"), F.col("_head")).otherwise(no),
    })
    return out.select(doc, *PARAGRAPH_COLUMNS)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of all text and Markdown files below a folder; doc_id is the path."""
    files = read_files(spark, path).withColumn("kind", file_type(F.col("path"))).where(F.col("kind").isin("txt", "md"))
    texts = files.select(F.col("path").alias("doc_id"), "kind", decoded("content").alias("text"))
    return parse_markdown(texts.where("kind = 'md'")).unionByName(parse_text(texts.where("kind = 'txt'")))


# --- archives ---


def _under(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0])))


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def epub_chapters(data: bytes) -> list[tuple[int, str, str, str]]:
    """(number, title, href, xhtml) in the order of the spine; titles from the NCX, else 'Chapter n'."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _tag(e) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): (_under(opf, e.get("href", "")), e.get("media-type", "")) for e in package.iter() if _tag(e) == "item"}
        titles: dict[str, str] = {}
        for href, kind in items.values():
            if kind == "application/x-dtbncx+xml" and href in names:
                for point in (e for e in ElementTree.fromstring(z.read(href)).iter() if _tag(e) == "navPoint"):
                    label = next(("".join(t.itertext()).strip() for t in point.iter() if _tag(t) == "text"), "")
                    src = next((c.get("src", "") for c in point if _tag(c) == "content"), "")
                    titles.setdefault(_under(href, src), label)
        out = []
        for ref in (e.get("idref") for e in package.iter() if _tag(e) == "itemref"):
            href = items.get(ref, ("", ""))[0]
            if href in names:
                n = len(out) + 1
                out.append((n, titles.get(href) or f"Chapter {n}", href, decode_bytes(z.read(href))))
        return out


def read_epub(files: DataFrame) -> DataFrame:
    """path, chapter_no, title, markdown of EPUB files (path, content)."""
    from lectern.sources.web import html_to_markdown

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, n, title, html_to_markdown(xhtml)) for p, c in zip(pdf["path"], pdf["content"], strict=True) for n, title, _, xhtml in epub_chapters(bytes(c))]
            yield pd.DataFrame(out, columns=["path", "chapter_no", "title", "markdown"])

    return files.select("path", "content").mapInPandas(run, "path string, chapter_no int, title string, markdown string")


def natural_key(name: str) -> list[tuple[int, int, str]]:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall(r"\d+|\D+", name)]


def summary_entries(text: str) -> list[tuple[str, str]]:
    """(title, path) of the Markdown links of an outline, one to a line."""
    found = (re.search(r"\[(.*?)\]\((.*?)\)", line) for line in text.splitlines())
    pairs = ((m[1].strip(), m[2].strip().split("#")[0]) for m in found if m)
    return [(t, p) for t, p in pairs if p.endswith((".md", ".markdown"))]


def nav_entries(text: str) -> list[tuple[str, str]]:
    """(title, path) of the nav section of a site configuration; untitled pages are named after their file."""
    out, inside = [], False
    for line in text.splitlines():
        if re.match(r"\s*nav:\s*$", line):
            inside = True
        elif inside and line and line[0] not in " \t":
            break
        elif inside:
            m = re.search(r"""-\s*(?:["']?([^"':]+)["']?\s*:\s*)?["']?([^"']+\.md)["']?""", line)
            if m:
                path = m[2].strip()
                out.append(((m[1] or "").strip() or posixpath.splitext(posixpath.basename(path))[0], path))
    return out


def folder_chapters(data: bytes) -> list[tuple[int, str, str, str]]:
    """(number, title, path, text) of an archive of Markdown: by SUMMARY or _sidebar, else the nav section, else in natural order with
    README first."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = {n: n for n in z.namelist() if n.lower().endswith((".md", ".markdown")) and not any(p.startswith((".", "__")) for p in n.split("/"))}
        by_base = {posixpath.basename(n).lower(): n for n in sorted(z.namelist())}
        entries: list[tuple[str, str]] = []
        for outline, read in (("summary.md", summary_entries), ("_sidebar.md", summary_entries), ("mkdocs.yml", nav_entries)):
            where = by_base.get(outline)
            if where and not entries:
                base = posixpath.dirname(where)
                for title, path in read(decode_bytes(z.read(where))):
                    tries = (posixpath.normpath(posixpath.join(base, prefix, path)) for prefix in ("", "docs", "Document"))
                    hit = next((t for t in tries if t in files), None)
                    if hit:
                        entries.append((title, hit))
        if not entries:
            skip = {"summary.md", "_sidebar.md"}
            order = sorted((n for n in files if posixpath.basename(n).lower() not in skip), key=lambda n: (not posixpath.basename(n).lower().startswith("readme"), natural_key(n)))
            entries = [(posixpath.splitext(posixpath.basename(n))[0], n) for n in order]
        return [(i, t, p, decode_bytes(z.read(p))) for i, (t, p) in enumerate(entries, 1)]


def read_folders(files: DataFrame) -> DataFrame:
    """path, chapter_no, title, entry and markdown of archives (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, *ch) for p, c in zip(pdf["path"], pdf["content"], strict=True) for ch in folder_chapters(bytes(c))]
            yield pd.DataFrame(out, columns=["path", "chapter_no", "title", "entry", "markdown"])

    return files.select("path", "content").mapInPandas(run, "path string, chapter_no int, title string, entry string, markdown string")


def archive_entries(files: DataFrame) -> DataFrame:
    """path and entry: the files in archives, whatever they are; with assets.local_files, where a name stood in the source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                    out += [(p, n) for n in z.namelist() if not n.endswith("/")]
            yield pd.DataFrame(out, columns=["path", "entry"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string")


def scanned_paragraphs(documents: DataFrame, toc: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One paragraph for each page of scanned documents (doc, total_pages), in the chapter of the top TOC entry (doc, level, title, page)
    whose range holds it; pages before the first entry, and documents without any, are in chapter 0."""
    from pyspark.sql import Window

    top = toc.join(toc.groupBy(doc).agg(F.min("level").alias("_top")), doc).where(F.col("level") == F.col("_top"))
    marked = top.join(documents.select(doc, "total_pages"), doc).select(doc, "title", F.col("page").alias("start"), "total_pages")
    ranges = S.toc_ranges(marked, doc, "start", "total_pages").withColumn("chapter_no", F.row_number().over(Window.partitionBy(doc).orderBy("start")))
    r = ranges.select(F.col(doc).alias("_d"), "title", "start", "end_page", "chapter_no")
    pages = documents.select(doc, F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page"))
    out = pages.join(r, (F.col(doc) == F.col("_d")) & F.col("page").between(F.col("start"), F.col("end_page")), "left")
    return out.select(
        doc, F.coalesce("chapter_no", F.lit(0)).alias("chapter_no"), F.coalesce("title", F.lit("Introduction")).alias("title"), "page", F.lit("scanned_page").alias("type"),
        F.format_string("p_%03d_%04d", F.coalesce("chapter_no", F.lit(0)), "page").alias("id"), F.concat(F.lit("page_"), F.lpad(F.col("page").cast("string"), 4, "0"), F.lit(".jpg")).alias("image_url"),
    )


# --- workbooks ---

MOST_ROWS, MOST_COLUMNS = 2000, 100


def cell_text(value) -> str:
    """A cell as text: dates without empty times, whole numbers without decimals, others with six digits."""
    import datetime as dt

    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d") if (value.hour, value.minute, value.second) == (0, 0, 0) else value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, dt.date):
        return value.strftime("%Y-%m-%d")
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else f"{value:g}"
    return str(value).strip()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook_sheets(data: bytes) -> list[tuple[str, dict[tuple[int, int], object], list[tuple[int, int, int, int]]]]:
    """(name, cells by row and column, merged ranges) of an xlsx file, in the order of the workbook."""
    import datetime as dt

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda p: ElementTree.fromstring(z.read(p))
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in xml("xl/sharedStrings.xml") if _tag(si) == "si"] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _tag(e) == "numFmt"}
            for k, xf in enumerate(x for e in styles if _tag(e) == "cellXfs" for x in e):
                f = int(xf.get("numFmtId", 0))
                if 14 <= f <= 22 or 45 <= f <= 47 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(f, "")), re.I):
                    dates.add(k)
        links = {e.get("Id"): _under("xl/workbook.xml", e.get("Target", "")).removeprefix("/") for e in xml("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in (e for e in xml("xl/workbook.xml").iter() if _tag(e) == "sheet"):
            part = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            cells, merged = {}, []
            for e in xml(part).iter():
                if _tag(e) == "c":
                    ref = e.get("r")
                    kind, raw = e.get("t", "n"), next((c.text for c in e if _tag(c) == "v"), None)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in e.iter() if _tag(t) == "t")
                    elif raw is None:
                        continue
                    elif kind == "s":
                        value = shared[int(raw)]
                    elif kind == "b":
                        value = raw == "1"
                    elif kind in ("str", "e"):
                        value = raw
                    elif int(e.get("s", 0)) in dates:
                        value = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(raw) * 86400))
                    else:
                        value = float(raw)
                    cells[int(re.search(r"\d+", ref)[0]), _column(ref)] = value
                elif _tag(e) == "mergeCell":
                    a, b = e.get("ref").split(":")
                    merged.append((int(re.search(r"\d+", a)[0]), _column(a), int(re.search(r"\d+", b)[0]), _column(b)))
            out.append((sheet.get("name"), cells, merged))
        return out


def sheet_html(cells: dict[tuple[int, int], object], merged: list[tuple[int, int, int, int]]) -> str:
    """The populated box of a sheet as an HTML table: merged cells span, blank rows are left out, the first row is a header."""
    import html

    texts = {k: t for k, v in cells.items() if k[0] <= MOST_ROWS and k[1] <= MOST_COLUMNS and (t := cell_text(v)) != ""}
    spots = [*texts, *((r, c) for a, b, x, y in merged if a <= MOST_ROWS and b <= MOST_COLUMNS for r, c in ((a, b), (min(x, MOST_ROWS), min(y, MOST_COLUMNS))))]
    if not texts:
        return ""
    top, bottom = min(r for r, _ in spots), max(r for r, _ in spots)
    left, right = min(c for _, c in spots), max(c for _, c in spots)
    starts = {(a, b): (x - a + 1, y - b + 1) for a, b, x, y in merged}
    hidden = {(r, c) for a, b, x, y in merged for r in range(a, min(x, bottom) + 1) for c in range(b, min(y, right) + 1)} - set(starts)
    rows = []
    for r in range(top, bottom + 1):
        if not any((r, c) in texts or (r, c) in hidden for c in range(left, right + 1)):
            continue
        tag = "td" if rows else "th"
        line = []
        for c in range(left, right + 1):
            if (r, c) in hidden:
                continue
            down, across = starts.get((r, c), (1, 1))
            span = (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{across}"' if across > 1 else "")
            line.append(f"<{tag}{span}>{html.escape(texts.get((r, c), '')).replace(chr(10), '<br>')}</{tag}>")
        rows.append(f"<tr>{''.join(line)}</tr>")
    return f"<table>{''.join(rows)}</table>"


def read_workbooks(files: DataFrame) -> DataFrame:
    """path, chapter_no, title and table (HTML) of the sheets that aren't empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                tables = [(name, sheet_html(cells, merged)) for name, cells, merged in workbook_sheets(bytes(c))]
                out += [(p, n, name, t) for n, (name, t) in enumerate(((a, b) for a, b in tables if b), 1)]
            yield pd.DataFrame(out, columns=["path", "chapter_no", "title", "table"])

    return files.select("path", "content").mapInPandas(run, "path string, chapter_no int, title string, table string")
