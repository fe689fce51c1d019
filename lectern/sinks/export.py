"""Rendering and export: Markdown, manifests, Anki packages, archives, tables.

What is written per document is a column of a DataFrame, so rendering is distributed; archives are packed per document in a task and come
back as binary rows, which any Spark writer stores. Nothing is collected.
"""

from __future__ import annotations

import hashlib
import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.context import ordered_text

# Labels of the rendered sections.
HEADER_LABEL, NOTES_LABEL, FOOTER_LABEL = "> 📌 **【全章导读与核心总览】**\n", "> 💡 **【研读注解】**\n", "> 🎯 **【本章回顾与考点复盘】**\n"


def quoted(x: Column) -> Column:
    return F.replace(x, F.lit("\n"), F.lit("\n> "))


def _notes(notes: Column, label: str, titled: bool, tail: str) -> Column:
    """A block of notes, or nothing."""

    def one(n: Column) -> Column:
        body = F.concat(F.lit("> "), quoted(F.coalesce(n["content"], F.lit(""))), F.lit("\n"))
        if not titled:
            return body
        t = T.strip(F.coalesce(n["title"], F.lit("")))
        return F.concat(F.when(t != "", F.concat(F.lit("> **"), t, F.lit("**\n"))).otherwise(""), body)

    return F.when(F.coalesce(F.size(notes), F.lit(0)) > 0, F.concat(F.lit(label), F.array_join(F.transform(notes, one), ""), F.lit(tail))).otherwise("")


def render_paragraph(language: str = "en", notes: Column | None = None) -> Column:
    """One paragraph as Markdown: text, quoted translation unless the document is Chinese or it is an image, notes, rule."""
    eng, cn = (T.strip(F.coalesce(c, F.lit(""))) for c in ("english", "chinese"))
    trans = F.when((F.col("type") != "image") & (cn != "") & F.lit(language != "zh"), F.concat(F.lit("> "), quoted(cn), F.lit("\n\n"))).otherwise("")
    parts = [eng, F.lit("\n\n"), trans]
    if notes is not None:
        parts.append(_notes(notes, NOTES_LABEL, False, "\n"))
    return F.concat(*parts, F.lit("---\n\n"))


def render_chapters(paragraphs: DataFrame, chapters: DataFrame, language: str = "en") -> DataFrame:
    """doc_id, chapter_id and markdown of each chapter; chapters may have header_notes and footer_notes, paragraphs notes."""
    note = F.col("notes") if "notes" in paragraphs.columns else None
    body = paragraphs.withColumn("_md", render_paragraph(language, note)).groupBy("doc_id", "chapter_id").agg(ordered_text("ord", F.col("_md"), "").alias("_body"))
    out = chapters.join(body, ["doc_id", "chapter_id"], "left")
    head = _notes(F.col("header_notes"), HEADER_LABEL, True, "\n---\n\n") if "header_notes" in chapters.columns else F.lit("")
    foot = _notes(F.col("footer_notes"), FOOTER_LABEL, True, "\n---\n\n") if "footer_notes" in chapters.columns else F.lit("")
    return out.select("doc_id", "chapter_id", "ch_ord", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), head, F.coalesce("_body", F.lit("")), foot).alias("markdown"))


def full_markdown(rendered: DataFrame) -> DataFrame:
    """doc_id and markdown of whole documents."""
    return rendered.groupBy("doc_id").agg(ordered_text("ch_ord", F.col("markdown"), "\n\n").alias("markdown"))


def relink_images(x: Column, target: str) -> Column:
    """Image links to the document's own images as relative paths under `target`; 'raw' leaves them."""
    return x if target == "raw" else F.regexp_replace(x, r"!\[([^\]]*)\]\((?:/api/study/documents/[^)]*?/images/|\./images/)([^)]*)\)", f"![$1]({target}/$2)")


def relink_matched(rows: DataFrame, images: DataFrame, target: Column, doc: str = "doc_id", text: str = "markdown") -> DataFrame:
    """rows with the links to a document's own images, `![alt](path)` and `<img src=path>`, to `target`/name; links that no image
    matches stay as they are. A link's file name, without escapes and case, is matched with images (doc, name)."""
    links = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(r"!\[.*?\]\(.*?\)"), F.lit(0)), lambda m: F.struct(m.alias("whole"), T.strip(F.regexp_extract(m, r"^!\[.*?\]\((.*?)\)$", 1)).alias("path"))),
        F.transform(F.regexp_extract_all(text, F.lit(r"""(?i)<img[^>]+src=["'][^"']+["'][^>]*>"""), F.lit(0)), lambda m: F.struct(m.alias("whole"), F.regexp_extract(m, r"""(?i)src=["']([^"']+)["']""", 1).alias("path"))),
    )
    file = F.lower(F.regexp_extract(F.try_url_decode(F.replace(F.element_at(F.split("path", r"\s+"), 1), F.lit("+"), F.lit("%2B"))), r"([^/]*)$", 1))
    seen = rows.select(doc, F.explode(links).alias("l")).select(doc, "l.whole", "l.path").distinct().withColumn("_file", file)
    names = images.select(F.col(doc).alias("_d"), F.lower("name").alias("_key"), "name").groupBy("_d", "_key").agg(F.min("name").alias("name"))
    hits = seen.join(names, (F.col(doc) == F.col("_d")) & (F.col("_file") == F.col("_key")))
    maps = hits.groupBy(F.col(doc).alias("_of")).agg(F.sort_array(F.collect_list(F.struct("whole", "path", F.concat(F.lit("/"), "name").alias("end")))).alias("_links"))
    both = rows.join(maps, F.col(doc) == F.col("_of"), "left")
    moved = lambda m: F.when(
        m["whole"].startswith("!"), F.concat(F.regexp_extract(m["whole"], r"^(!\[.*?\])", 1), F.lit("("), target, m["end"], F.lit(")"))
    ).otherwise(F.replace(m["whole"], m["path"], F.concat(target, m["end"])))
    none = F.array().cast("array<struct<whole:string,path:string,end:string>>")
    return both.withColumn(text, F.aggregate(F.coalesce("_links", none), F.col(text), lambda a, m: F.replace(a, m["whole"], moved(m)))).select(rows.columns)


def inline_images(rendered: DataFrame, images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Markdown with the images (doc, name, content) it links to as data URIs; unknown ones stay."""
    maps = images.select(doc, "name", T.data_uri(F.col("name"), F.col("content")).alias("uri")).groupBy(doc).agg(F.collect_list(F.struct("name", "uri")).alias("_i"))
    rows = rendered.join(maps, doc, "left")
    none = F.array().cast("array<struct<name:string,uri:string>>")
    return rows.withColumn("markdown", F.aggregate(F.coalesce("_i", none), F.col("markdown"), lambda a, m: F.replace(a, F.concat(F.lit("](./images/"), m["name"], F.lit(")")), F.concat(F.lit("]("), m["uri"], F.lit(")"))))).drop("_i")


def manifest(documents: DataFrame, chapters: DataFrame, cards: DataFrame) -> DataFrame:
    """Library entries: counts, tags (type, then chapter titles of up to 8 characters, four in all), description."""
    n_cards = cards.groupBy("doc_id").agg(F.count("*").alias("flashcard_count"))
    short = F.array_sort(F.collect_list(F.when(F.length("title").between(1, 8), F.struct("ch_ord", "title"))))
    titles = chapters.groupBy("doc_id").agg(F.transform(short, lambda x: x["title"]).alias("_titles"))
    out = documents.join(n_cards, "doc_id", "left").join(titles, "doc_id", "left")
    tags = F.concat(F.when(F.col("file_type") != "", F.array(F.upper("file_type"))).otherwise(F.array().cast("array<string>")), F.coalesce("_titles", F.array().cast("array<string>")))
    n, k = F.coalesce("total_paragraphs", F.lit(0)), F.coalesce("flashcard_count", F.lit(0))
    return out.select(
        "doc_id", F.col("filename").alias("title"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("/index.html")).alias("path"), n.alias("paragraph_count"), k.alias("flashcard_count"),
        F.col("file_type").alias("type"), F.slice(F.array_distinct(tags), 1, 4).alias("tags"),
        F.concat(F.lit("共包含 "), n.cast("string"), F.lit(" 个研学段落，配套 "), k.cast("string"), F.lit(" 个考点记忆闪卡。")).alias("description"),
    )


def seo(paragraphs: DataFrame, order: str = "ord") -> DataFrame:
    """doc_id and description: the first three cleaned texts of over 20 characters, cut to 150."""
    from pyspark.sql import Window

    raw = T.strip(F.coalesce(F.nullif("chinese", F.lit("")), "english", F.lit("")))
    rows = paragraphs.withColumn("_t", T.seo_clean(raw)).where((raw != "") & ~raw.startswith("![") & (F.length("_t") > 20))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).where("_n <= 3")
    return first.groupBy("doc_id").agg(F.concat(T.strip(F.left(ordered_text("_n", F.col("_t"), " "), F.lit(150))), F.lit("...")).alias("description"))


def card_payload(cards: DataFrame) -> DataFrame:
    """doc_id and the cards as JSON, for a page that shows them."""
    one = F.struct(*[c for c in cards.columns if c != "doc_id"])
    return cards.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("payload"))


def sse(chunk: Column) -> Column:
    """A chunk (struct) as a server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(chunk), F.lit("\n\n"))


# --- Anki packages ---

_TABLES = """
create table col (id integer primary key, crt integer not null, mod integer not null, scm integer not null, ver integer not null, dty integer not null, usn integer not null, ls integer not null, conf text not null, models text not null, decks text not null, dconf text not null, tags text not null);
create table notes (id integer primary key, guid text not null, mid integer not null, mod integer not null, usn integer not null, tags text not null, flds text not null, sfld integer not null, csum integer not null, flags integer not null, data text not null);
create table cards (id integer primary key, nid integer not null, did integer not null, ord integer not null, mod integer not null, usn integer not null, type integer not null, queue integer not null, due integer not null, ivl integer not null, factor integer not null, reps integer not null, lapses integer not null, left integer not null, odue integer not null, odid integer not null, flags integer not null, data text not null);
create table revlog (id integer primary key, cid integer not null, usn integer not null, ease integer not null, ivl integer not null, lastIvl integer not null, factor integer not null, time integer not null, type integer not null);
create table graves (usn integer not null, oid integer not null, type integer not null);
"""
BASIC, CLOZE, DECK = 1_600_000_000_001, 1_600_000_000_002, 1_600_000_000_003
#: Decks that a task holds as Python values at a time.
DECKS = 100


def anki_notes(cards: DataFrame, number_clozes: bool = False) -> DataFrame:
    """doc_id, guid, kind, fields, tags, checksum of the notes; clozes are numbered on request."""
    front = T.numbered_cloze(F.col("front")) if number_clozes else F.col("front")
    a, b = F.col("_a"), F.col("_b")
    return cards.withColumns({"_a": T.anki_html(front), "_b": T.anki_html(F.col("back"))}).select(
        "doc_id", "id", T.anki_guid(F.concat_ws("\u001f", F.col("doc_id").cast("string"), "id", "front")).alias("guid"), F.col("type").alias("kind"),
        F.concat_ws("\u001f", a, b).alias("fields"), a.alias("sort_field"), F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.replace(t, F.lit(" "), F.lit("_"))), " ").alias("tags"),
        T.anki_checksum(a).alias("checksum"), F.coalesce("stats.interval_days", F.lit(0)).cast("long").alias("ivl"), (F.coalesce("stats.ease_factor", F.lit(2.5)) * 1000).cast("int").alias("factor"),
        F.coalesce("stats.reps", F.lit(0)).alias("reps"), F.coalesce("stats.lapses", F.lit(0)).alias("lapses"),
    )


@lru_cache(maxsize=1)
def _empty_collection() -> bytes:
    con = sqlite3.connect(":memory:")
    con.executescript(_TABLES)
    return con.serialize()


def apkg_bytes(deck: str, notes: list[dict], now: int) -> bytes:
    """An Anki package of one deck."""
    models = {}
    for mid, name, cloze in ((BASIC, "Basic", 0), (CLOZE, "Cloze", 1)):
        q, a = ("{{cloze:Front}}", "{{cloze:Front}}<hr>{{Back}}") if cloze else ("{{Front}}", "{{FrontSide}}<hr>{{Back}}")
        models[str(mid)] = {"id": mid, "name": name, "type": cloze, "mod": now, "usn": -1, "sortf": 0, "did": DECK, "css": "", "flds": [{"name": n, "ord": i} for i, n in enumerate(("Front", "Back"))], "tmpls": [{"name": "Card 1", "ord": 0, "qfmt": q, "afmt": a}], "req": [[0, "any", [0]]]}
    decks = {str(DECK): {"id": DECK, "name": deck, "mod": now, "usn": -1, "desc": "", "conf": 1, "dyn": 0}}
    con = sqlite3.connect(":memory:")
    con.deserialize(_empty_collection())
    con.execute("insert into col values (1, ?, ?, ?, 11, 0, 0, 0, '{}', ?, ?, '{}', '{}')", (now, now * 1000, now * 1000, json.dumps(models), json.dumps(decks)))
    rows, cards = [], []
    for k, n in enumerate(notes):
        nid, mid = now * 1000 + 2 * k, CLOZE if n["kind"] == "cloze" else BASIC
        rows.append((nid, n["guid"], mid, now, f" {n['tags']} " if n["tags"] else "", n["fields"], n["sort_field"], n["checksum"]))
        seen = n["reps"] > 0
        cards.append((nid + 1, nid, DECK, now, 2 if seen else 0, 2 if seen else 0, k, n["ivl"], n["factor"], n["reps"], n["lapses"]))
    con.executemany("insert into notes values (?, ?, ?, ?, -1, ?, ?, ?, ?, 0, '')", rows)
    con.executemany("insert into cards values (?, ?, ?, 0, ?, -1, ?, ?, ?, ?, ?, ?, ?, 0, 0, 0, 0, '')", cards)
    con.commit()
    data = con.serialize()
    con.close()
    return _archive([("collection.anki2", data), ("media", b"{}")])


def anki_packages(cards: DataFrame, now: int, number_clozes: bool = False) -> DataFrame:
    """doc_id, n_notes and the package (binary) of each document's deck."""
    notes = anki_notes(cards, number_clozes)
    decks = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", *(c for c in notes.columns if c not in ("doc_id", "id"))))).alias("notes"))
    kind = notes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DECKS):
                part = batch.slice(at, DECKS)
                own = part.column("notes").to_pylist()
                packed = [apkg_bytes(f"Lectern::{doc}", rows, now) for doc, rows in zip(part.column("doc_id").to_pylist(), own, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, own), pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "n_notes", "apkg"])

    return decks.mapInArrow(run, f"doc_id {kind}, n_notes int, apkg binary")


# --- archives and tables ---


def _archive(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def markdown_archives(whole: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id and archive (binary): the document's Markdown and its images, packed in the tasks that hold the rows."""
    rows = whole.select("doc_id", "markdown")
    none = F.array().cast("array<struct<name:string,content:binary>>")
    if images is not None:
        rows = rows.join(images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("images")), "doc_id", "left")
    else:
        rows = rows.withColumn("images", none)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [_archive([("document.md", m.encode()), *((f"images/{i['name']}", bytes(i["content"])) for i in (x if x is not None else []))]) for m, x in zip(pdf["markdown"], pdf["images"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "archive": packed})

    return rows.mapInPandas(run, f"doc_id {kind}, archive binary")


def _escaped(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def html_book(rendered: DataFrame, documents: DataFrame, chapters: DataFrame | None = None, descriptions: DataFrame | None = None, keywords: int = 10, empty: bool = False) -> DataFrame:
    """doc_id and html: a plain page with contents, description and keywords (titles of the first chapters) where given, and chapters.

    With empty, documents without chapters have a page as well.
    """
    rows = rendered.select("doc_id", "chapter_id", "ch_ord", "markdown")
    if chapters is not None:
        rows = rows.join(chapters.select("doc_id", "chapter_id", F.col("title").alias("_title")), ["doc_id", "chapter_id"], "left")
    title = F.coalesce("_title", "chapter_id") if chapters is not None else F.col("chapter_id")
    part = F.concat(F.lit('<section id="'), F.col("chapter_id"), F.lit('"><pre>'), T.html_inline(F.col("markdown")), F.lit("</pre></section>"))
    toc = F.concat(F.lit('<li><a href="#'), F.col("chapter_id"), F.lit('">'), _escaped(title), F.lit("</a></li>"))
    titles = F.array_sort(F.collect_list(F.struct("ch_ord", title.alias("t"))))
    named = F.array_join(F.transform(F.slice(titles, 1, keywords), lambda x: x["t"]), ", ") if chapters is not None else F.lit("")
    pages = rows.groupBy("doc_id").agg(ordered_text("ch_ord", part, "").alias("_body"), ordered_text("ch_ord", toc, "").alias("_toc"), (named if chapters is not None else F.first(named)).alias("_words"))
    out = pages.join(documents.select("doc_id", "filename"), "doc_id", "right" if empty else "inner")
    out = out.join(descriptions.select("doc_id", "description"), "doc_id", "left") if descriptions is not None else out.withColumn("description", F.lit(""))
    meta = lambda name, x: F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit(f'<meta name="{name}" content="'), _escaped(x), F.lit('">')))
    head = F.concat(F.lit("<!doctype html><title>"), _escaped(F.col("filename")), F.lit("</title>"), meta("description", F.col("description")), meta("keywords", F.col("_words")))
    return out.select("doc_id", F.concat(head, F.lit("<ol>"), F.coalesce("_toc", F.lit("")), F.lit("</ol>"), F.coalesce("_body", F.lit(""))).alias("html"))


#: Entries to a file of the library's list or map.
PER_FILE = 50_000


def library_files(entries: DataFrame, books: DataFrame, base: str, per_file: int = PER_FILE) -> DataFrame:
    """path and content of a static library's files: each book, its list (docs-N.json) and its map (sitemap-N.xml), in parts.

    With the entries and books of changed documents alone, these are the files of a patch. Parts are chosen by a hash of the path, so
    a document stays in its part as long as their number does.
    """
    n = max(1, -(-entries.count() // per_file))
    part = F.pmod(F.xxhash64("path"), F.lit(n)).cast("string").alias("part")
    row = F.struct("path", *[c for c in entries.columns if c != "path"])
    lists = entries.select(part, row.alias("r")).groupBy("part").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("content"))
    maps = entries.select(part, "path", F.concat(F.lit(f"<url><loc>{base}/"), _escaped(F.col("path")), F.lit("</loc></url>")).alias("u"))
    maps = maps.groupBy("part").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), ordered_text("path", F.col("u"), ""), F.lit("</urlset>")).alias("content"))
    pages = books.join(entries.select("doc_id", "path").distinct(), "doc_id").select("path", F.col("html").alias("content"))
    return pages.unionByName(lists.select(F.concat(F.lit("docs-"), "part", F.lit(".json")).alias("path"), "content")).unionByName(maps.select(F.concat(F.lit("sitemap-"), "part", F.lit(".xml")).alias("path"), "content"))


def portal_page(entries: DataFrame, most: int = 100) -> DataFrame:
    """path and content of the library's front page: links to the first entries by title (and path)."""
    first = entries.select("title", "path", "description").orderBy("title", "path").limit(most)
    link = F.concat(F.lit('<li><a href="'), _escaped(F.col("path")), F.lit('">'), _escaped(F.col("title")), F.lit("</a> "), _escaped(F.coalesce("description", F.lit(""))), F.lit("</li>"))
    rows = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("title", "path", link.alias("l")))).alias("r"))
    return rows.select(F.lit("index.html").alias("path"), F.concat(F.lit("<!doctype html><ul>"), F.array_join(F.transform("r", lambda x: x["l"]), ""), F.lit("</ul>")).alias("content"))


def site_archives(books: DataFrame, payloads: DataFrame) -> DataFrame:
    """doc_id and archive (binary) of static sites: the book as index.html, and its cards as flashcards.json."""
    rows = books.select("doc_id", "html").join(payloads.select("doc_id", "payload"), "doc_id", "left")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [_archive([("index.html", h.encode()), ("flashcards.json", (c or "[]").encode())]) for h, c in zip(pdf["html"], pdf["payload"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "archive": packed})

    return rows.mapInPandas(run, f"doc_id {kind}, archive binary")


def patched_manifest(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Library entries with those of new or changed documents in place of their old ones."""
    return entries.join(new.select("doc_id"), "doc_id", "left_anti").select(entries.columns).unionByName(new.select(entries.columns))


#: Formats of export(): what each gives for every document.
FORMATS = ("markdown", "raw_markdown", "markdown_zip", "anki", "html", "flashcards_json", "site_zip")


def export(fmt: str, paragraphs: DataFrame, chapters: DataFrame, documents: DataFrame, cards: DataFrame, now: int = 0) -> DataFrame:
    """Rows of the chosen format, one for each document."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if fmt == "anki":
        return anki_packages(cards, now)
    if fmt == "flashcards_json":
        return card_payload(cards)
    rendered = render_chapters(paragraphs, chapters)
    if fmt == "html":
        return html_book(rendered, documents)
    if fmt == "site_zip":
        return site_archives(html_book(rendered, documents), card_payload(cards))
    whole = full_markdown(rendered)
    if fmt == "markdown_zip":
        return markdown_archives(whole)
    return whole.withColumn("markdown", relink_images(F.col("markdown"), "raw" if fmt == "raw_markdown" else "images"))


def write_table(df: DataFrame, path: str, by: str = "doc_id") -> None:
    """Replaces the partitions of the documents in df and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def content_key(*parts: str) -> str:
    return hashlib.sha256("\u001f".join(parts).encode()).hexdigest()
