"""Laid-out documents: spans, table boxes and images of pages to chapters of paragraphs, as one plan.

    spans   doc_id, page, x0, y0, x1, y1, text, size, flags, font      pieces of text of one font, as a layout reader gives them
    pages   doc_id, page, height
    boxes   doc_id, page, x0, y0, x1, y1                               what a table finder reports
    images  doc_id, page, x0, y0, x1, y1, src
    toc     doc_id, n, level, title, page                              n: place in the table of contents

Spans become lines by a sweep over the heights, lines lose what stands in tables and margins, become paragraphs and lists page by page,
and take their places among tables and images; blocks are then stitched across pages and parted into chapters by the table of
contents, or by strict headings, or stay one chapter. Everything is windows, joins and grouping by document or page; only the choice of
chapter starts, over scores, runs in Python. Lines, items and blocks are read more than once, so each is written to the shared folder.

Defined cases: spans without characters are left out; a page without a row in `pages` has no margins; a document without spans
and pictures gives no rows; without a table of contents and strict headings it is one chapter, "Document Body"; the first chapter starts with
the first block. Pages are numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import structure as S
from lectern.sinks.versions import settled

DOC, PAGE = ["doc_id"], ["doc_id", "page"]
#: Share of a page's height that is margin, at the top and at the bottom.
MARGIN = 0.11
#: Documents of so many pages are parted by strict headings, so many blocks apart, where they have no table of contents.
MANY_PAGES, APART = 6, 4
WHOLE = "Document Body"
# Kinds of items in the order in which they stand at equal heights.
TABLE, IMAGE, TEXT = range(3)


def lines_of(spans: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, x0, y0, x1, y1, size, bold: spans of a page, from top to bottom; a span whose middle lies below all
    earlier ones opens a line. Within a line, spans stand from left to right."""
    kept = spans.where(F.col("text") != "")
    sweep = Window.partitionBy(*PAGE).orderBy("y0", "x0", "x1", "text").rowsBetween(Window.unboundedPreceding, -1)
    starts = (F.col("y0") + F.col("y1")) / 2 >= F.coalesce(F.max("y1").over(sweep), F.lit(float("-inf")))
    rows = S.islands(kept.withColumn("_starts", starts), PAGE, ["y0", "x0", "x1", "text"], F.col("_starts"), "ord")
    parts = F.array_sort(F.collect_list(F.struct("x0", "y0", "text", "flags", "font")))
    lines = rows.groupBy(*PAGE, "ord").agg(
        parts.alias("_parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"),
    )
    text = T.strip(F.array_join(F.transform("_parts", lambda p: p["text"]), ""))
    return lines.select(*PAGE, "ord", text.alias("text"), "x0", "y0", "x1", "y1", "size", (S.bold_ratio(F.col("_parts")) >= S.BOLD).alias("bold")).where(F.col("text") != "")


def body_sizes(spans: DataFrame) -> DataFrame:
    """doc_id and body_size, the most frequent size of spans that aren't bold."""
    order = F.row_number().over(Window.partitionBy(*DOC).orderBy("page", "y0", "x0", "x1", "text"))
    return S.body_font_size(spans.withColumn("ord", order), "doc_id")


def told_lines(lines: DataFrame, pages: DataFrame, tables: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines outside tables, without page numbers and running lines, with pitch and what the rules say of each."""
    outside = S.outside_tables(lines, tables, PAGE)
    tall = outside.join(pages.select(*PAGE, "height"), PAGE, "left").join(sizes, DOC, "left")
    band = F.when(F.col("y0") < MARGIN * F.col("height"), "top").when(F.col("y1") > (1 - MARGIN) * F.col("height"), "bottom")
    body = S.without_running_lines(tall.withColumn("band", band), "doc_id", "page", "band", "text").withColumn("body_size", F.coalesce("body_size", "size"))
    pitch = S.line_pitch(body.select(*PAGE, "ord", "y0", "x0"), PAGE, ["y0", "x0"], F.lit(None).cast("double"))
    t = F.col("text")
    order = Window.partitionBy(*PAGE).orderBy("ord")
    plain = ~F.col("bold") & (F.col("size") < 1.14 * F.col("body_size"))
    told = body.join(pitch, PAGE).withColumns({
        "pitch": F.coalesce("pitch", 1.35 * F.col("body_size")), "is_list": T.is_list_item(t), "is_caption": T.is_caption(t), "terminal": T.is_sentence_terminal(t),
    }).withColumn("_follows", F.coalesce(F.lead(plain).over(order) & (F.lead("y0").over(order) - F.col("y0") <= 1.5 * F.col("pitch")), F.lit(False)))
    level = T.size_heading_level(F.col("size"), F.col("body_size"), F.col("bold"), t, F.col("is_list"), F.col("is_caption"), F.col("_follows"))
    told = told.withColumn("level", level).withColumn("is_list", F.col("is_list") & (F.col("level") == 0))
    return told.withColumn("list_type", F.when(F.col("is_list"), T.list_type(t)).otherwise("")).drop("_follows")


def _paragraph_starts(rows: Column) -> Column:
    """Which lines of a page open a paragraph. The state holds facts on the paragraph so far, not its text."""
    more = lambda x, a, b: F.regexp_count(x, F.lit(a)) - F.regexp_count(x, F.lit(b))
    first = F.struct(
        F.array().cast("array<boolean>").alias("starts"), F.lit(0.0).alias("y0"), F.lit(0).alias("round"), F.lit(0).alias("square"), F.lit(True).alias("terminal"),
        F.lit(False).alias("colon"), F.lit(True).alias("closed"), F.lit(False).alias("wraps"),
    )

    def step(a: Column, b: Column) -> Column:
        heading = b["level"] > 0
        gap = F.when(F.coalesce(b["pitch"], F.lit(0.0)) > 0, (b["y0"] - a["y0"]) / b["pitch"]).otherwise(0.0)
        opened = (a["round"] > 0) | (a["square"] > 0)
        near = (opened & (gap <= 2.5)) | (~a["terminal"] & ~b["is_list"] & (gap <= 2.2)) | (a["colon"] & (gap <= 1.4) & ~b["is_caption"]) | ((gap <= 1.35) & ~b["is_list"] & ~b["is_caption"])
        joins = ~heading & (a["wraps"] | (~a["closed"] & near))
        so_far = lambda k, n: n + F.when(joins, a[k]).otherwise(0)
        ends = F.regexp_replace(b["text"], r"(?U)[*_`\s]+$", "").rlike(r"[-,(\[{—]$")
        return F.struct(
            F.concat(a["starts"], F.array(~joins)).alias("starts"), b["y0"].cast("double").alias("y0"), so_far("round", more(b["text"], r"\(", r"\)")).alias("round"),
            so_far("square", more(b["text"], r"\[", r"\]")).alias("square"), b["terminal"].alias("terminal"), b["text"].rlike("[:：]$").alias("colon"),
            F.when(joins, a["closed"]).otherwise(heading | b["is_caption"]).alias("closed"), (F.when(joins, a["wraps"]).otherwise(heading) & ends).alias("wraps"),
        )

    return F.aggregate(rows, first, step)["starts"]


def text_items(told: DataFrame) -> DataFrame:
    """doc_id, page, n, x0, y0, content, level, is_list, list_type: paragraphs, lists, headings and captions of each page, in order."""
    line = F.struct("ord", "text", "x0", "y0", "pitch", "level", "is_list", "list_type", "is_caption", "terminal")
    rows = told.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("rows"))
    each = rows.select(*PAGE, F.posexplode(F.arrays_zip(F.col("rows").alias("line"), _paragraph_starts(F.col("rows")).alias("starts"))).alias("at", "r")).select(*PAGE, "at", "r.line", "r.starts")
    numbered = S.islands(each, PAGE, ["at"], F.col("starts"), "n")
    hyphen, whole = F.col("line.text").endswith("-"), F.col("line.text")
    last = F.lead("n").over(Window.partitionBy(*PAGE).orderBy("at")).eqNullSafe(F.col("n"))  # more lines of this paragraph follow
    piece = F.when(~last, whole).when(hyphen, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(F.concat(whole, F.lit(" ")))
    paragraphs = numbered.withColumn("_piece", piece).groupBy(*PAGE, "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_piece"))), lambda p: p["_piece"]), "").alias("content"),
        F.max(F.struct("at", F.col("line.y0").alias("y0")))["y0"].alias("y0"), F.min(F.struct("at", "line"))["line"].alias("_first"),
    )
    firsts = paragraphs.select(*PAGE, "n", "content", "y0", *(F.col("_first")[c].alias(c) for c in ("x0", "level", "is_list", "list_type", "is_caption")))
    grouped = S.list_groups(firsts.withColumn("list_type", F.when(F.col("is_list"), F.col("list_type")).otherwise("")), PAGE, ["n"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda p: p["content"])
    lists = grouped.groupBy(*PAGE, "list_group").agg(
        F.array_join(parts, "\n").alias("content"), F.max(F.struct("n", "y0"))["y0"].alias("y0"), F.min(F.struct("n", "x0", "level", "is_list", "list_type", "is_caption")).alias("_first"),
    )
    c, level = T.strip(F.col("content")), F.col("_first.level")
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.strip(F.regexp_replace("content", r"^[#\s]+", "")))
    caption = F.when(c.startswith("**") & c.endswith("**"), c).otherwise(F.concat(F.lit("**"), c, F.lit("**")))
    return lists.select(
        *PAGE, F.col("list_group").alias("n"), F.col("_first.x0").alias("x0"), "y0", F.when(level > 0, heading).when(F.col("_first.is_caption"), caption).otherwise(F.col("content")).alias("content"),
        level.alias("level"), F.col("_first.is_list").alias("is_list"), F.col("_first.list_type").alias("list_type"),
    )


def page_items(texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page, ord (from 0), type, content, level, is_list, list_type: all items of each page from top to bottom; at equal heights tables come before
    images and these before texts, then what stands further left."""
    none = {"level": F.lit(0), "is_list": F.lit(False), "list_type": F.lit("")}
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0"))
    said = F.format_string("![Table %d](images/tbl_p%03d_%04d.png)", number, F.col("page").cast("int"), number)
    found = tables.select(*PAGE, F.lit(TABLE).alias("kind"), number.alias("n"), "x0", "y0", F.lit("image").alias("type"), said.alias("content")).withColumns(none)
    counter = F.row_number().over(Window.partitionBy(*DOC).orderBy("page", "y0", "x0", "src"))
    pictures = images.select(*PAGE, F.lit(IMAGE).alias("kind"), counter.alias("n"), "x0", "y0", F.lit("image").alias("type"), F.format_string("![Figure %d](%s)", counter, "src").alias("content")).withColumns(none)
    own = texts.select(*PAGE, F.lit(TEXT).alias("kind"), F.col("n").cast("int").alias("n"), "x0", "y0", F.lit("text").alias("type"), "content", "level", "is_list", "list_type")
    every = found.unionByName(pictures).unionByName(own)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "kind", "x0", "n")) - 1
    return every.select(*PAGE, order.alias("ord"), "type", "content", "level", "is_list", "list_type")


def stitched(items: DataFrame) -> DataFrame:
    """doc_id, ord (from 0), page, type, content, level, is_list: items joined across page ends, in order."""
    blocks = items.withColumn("is_heading", F.col("level") > 0)
    joined = S.stitch_pages(blocks, DOC, "page", "ord", "content").select("doc_id", "page", F.col("first_order").alias("ord"), F.col("content").alias("_content"))
    both = blocks.join(joined, ["doc_id", "page", "ord"])
    number = F.row_number().over(Window.partitionBy(*DOC).orderBy("page", "ord")) - 1
    return both.select("doc_id", number.alias("ord"), "page", "type", F.col("_content").alias("content"), "level", "is_list")


def chapter_targets(toc: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, n, title, start_page, block_idx: where chapters ought to start.

    From the table of contents, its topmost level, or the one below where the topmost has one entry; else strict headings of levels 1 and
    2 in documents of MANY_PAGES, at least APART blocks and a page from the last one, if there are two; else the whole document.
    """
    lowest = F.min("level").over(Window.partitionBy(*DOC))
    below = F.min(F.when(F.col("level") > F.col("_low"), F.col("level"))).over(Window.partitionBy(*DOC))
    tops = F.count_if(F.col("level") == F.col("_low")).over(Window.partitionBy(*DOC))
    levels = toc.withColumn("_low", lowest).withColumn("_below", below).withColumn("_tops", tops)
    used = levels.where(F.col("level") == F.when((F.col("_tops") == 1) & F.col("_below").isNotNull(), F.col("_below")).otherwise(F.col("_low")))
    n = F.row_number().over(Window.partitionBy(*DOC).orderBy("n"))
    listed = used.select("doc_id", n.alias("n"), T.strip(F.col("title")).alias("title"), F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), "page")).alias("start_page"), F.lit(None).cast("int").alias("block_idx"))

    clean = T.strip(F.regexp_replace(T.strip(F.col("content")), r"^[#\s]+", ""))
    long = pages.groupBy("doc_id").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= MANY_PAGES)
    strict = blocks.where(F.col("level").between(1, 2) & T.is_heading(clean)).join(toc.select("doc_id"), DOC, "left_anti").join(long, DOC, "left_semi")
    rows = strict.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "page", clean.alias("title")))).alias("rows"))
    far = lambda last, x: (x["ord"] - last["ord"] >= APART) & (x["page"] - last["page"] >= 1)
    chosen = F.aggregate("rows", F.slice("rows", 1, 1), lambda kept, x: F.when(far(F.element_at(kept, -1), x), F.concat(kept, F.array(x))).otherwise(kept))
    picked = rows.select("doc_id", chosen.alias("c")).where(F.size("c") >= 2).select("doc_id", F.posexplode("c").alias("at", "h"))
    headed = picked.select("doc_id", (F.col("at") + 1).alias("n"), "h.title", F.when(F.col("at") == 0, 1).otherwise(F.col("h.page")).alias("start_page"), F.when(F.col("at") == 0, 0).otherwise(F.col("h.ord")).alias("block_idx"))

    # Written before they are joined: a union keeps its parts' partitioning in the plan, and loses it where a part turns into a broadcast join.
    known = settled(listed.unionByName(headed), "starts")
    rest = blocks.select("doc_id").distinct().join(known.select("doc_id").distinct(), DOC, "left_anti")
    return settled(known.unionByName(rest.select("doc_id", F.lit(1).alias("n"), F.lit(WHOLE).alias("title"), F.lit(1).alias("start_page"), F.lit(0).alias("block_idx"))), "targets")


def document_chapters(spans: DataFrame, pages: DataFrame, boxes: DataFrame, images: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, chapter_no, chapter_id, title, id, page, type, content of every paragraph of laid-out documents, in order of id."""
    tables = S.merged_tables(boxes, PAGE)
    told = told_lines(settled(lines_of(spans), "lines"), pages, tables, body_sizes(spans))
    items = settled(page_items(text_items(settled(told, "told")), tables, S.outside_tables(images, tables, PAGE)), "items")
    blocks = settled(stitched(items), "blocks")
    parts = S.partition_chapters(blocks.withColumn("is_heading", F.col("level") > 0), chapter_targets(toc, blocks, pages), "doc_id")
    named = S.paragraph_ids(parts.withColumn("chapter_id", F.format_string("ch_%03d", F.col("chapter_no").cast("int"))), DOC, ["ord"])
    return named.select("doc_id", "chapter_no", "chapter_id", "title", "id", "page", "type", "content")
