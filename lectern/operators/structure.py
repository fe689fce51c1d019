"""From lines and paragraphs to chapters; layout rules over lines, blocks and pages."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

BATCH, LONG_DOCUMENT = 45, 50
SIMILAR, CONFIDENT, SURE, MIN_BLOCKS, NEAR = 0.5, 0.70, 0.85, 2, 4


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """rows with a running count of group starts (0 before the first)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def chapter_ids(rows: DataFrame, keys: list[str], order: list[str], heading: Column) -> DataFrame:
    """rows with chapter_no (from 1) and chapter_id: each heading opens a chapter; what comes before the first is a chapter too."""
    found = islands(rows, keys, order, heading, "_k")
    first = F.min("_k").over(Window.partitionBy(*keys))
    no = F.col("_k") - first + 1
    return found.withColumn("chapter_no", no).withColumn("chapter_id", F.format_string("ch_%03d", no)).drop("_k")


def paragraph_ids(rows: DataFrame, keys: list[str], order: list[str], chapter_no: str = "chapter_no") -> DataFrame:
    """rows with id: chapter number and a number that runs through the document."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("id", F.format_string("p_%03d_%04d", F.col(chapter_no).cast("int"), n))


def batch_chapters(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Chapters for texts without headings: batches of 45 paragraphs where there are more than 50, else one."""
    w = Window.partitionBy(*keys)
    n, total = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return rows.withColumn("chapter_no", F.when(total > LONG_DOCUMENT, F.floor((n - 1) / BATCH) + 1).otherwise(1).cast("int"))


def _level_counts(text: str, is_code: Column) -> dict[str, Column]:
    return {f"h{k}": F.count_if(~is_code & F.col(text).rlike(rf"^#{{{k}}}\s+[^#]")) for k in (1, 2, 3)}


def _rule() -> Column:
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    return F.when(h1 >= 2, "#").when((h1 == 1) & (h2 >= 1), "#{1,2}").when(h1 == 1, "#").when(h2 >= 1, "##").when(h3 >= 2, "###").otherwise("")


def heading_census(blocks: DataFrame, keys: list[str], text: str, is_code: Column) -> DataFrame:
    """Headings by level, and the level pattern that opens chapters ('' if none does)."""
    return blocks.groupBy(*keys).agg(*(c.alias(k) for k, c in _level_counts(text, is_code).items())).withColumn("rule", _rule())


def with_heading_rule(blocks: DataFrame, keys: list[str], text: str, is_code: Column) -> DataFrame:
    """blocks with their document's rule of the census; over a window, so that the blocks are found once."""
    w = Window.partitionBy(*keys)
    return blocks.withColumns({k: c.over(w) for k, c in _level_counts(text, is_code).items()}).withColumn("rule", _rule()).drop("h1", "h2", "h3")


def stitch_pages(blocks: DataFrame, keys: list[str], page: str, order: str, text: str, lang: str = "en") -> DataFrame:
    """Blocks joined across page ends: keys, first_order, content.

    The first block of a page continues the last of the page before if both are body text and that doesn't end a sentence, or if
    both are list items of one kind. Blocks have type, is_heading, is_list, list_type.
    """
    w = Window.partitionBy(*keys).orderBy(page, order)
    prev = lambda c: F.lag(c).over(w)
    bare = F.regexp_replace(T.strip(F.col(text)), r"(?U)[*_`\s]+$", "")
    open_end = ~T.is_sentence_terminal(bare)
    body = (F.col("type") == "text") & ~F.col("is_heading") & ~F.col("is_list")
    marked = blocks.withColumn("_open", body & open_end).withColumn("_body", body).withColumn("_item", F.col("is_list") & ~F.col("is_heading"))
    new_page = prev(page).isNotNull() & (F.col(page) != prev(page))
    goes_on = F.coalesce(new_page & prev("_open") & F.col("_body"), F.lit(False))
    same_list = F.coalesce(new_page & prev("_item") & F.col("_item") & (prev("list_type") == F.col("list_type")), F.lit(False))
    joins = marked.withColumn("_on", goes_on).withColumn("_list", same_list)
    grouped = islands(joins, [*keys], [page, order], ~(F.col("_on") | F.col("_list")), "_g")
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(order).alias("o"), F.col(text).alias("t"), F.col("_list").alias("l"))))
    end = lambda a: F.regexp_replace(T.strip(a), r"(?U)[*_`\s]+$", "")
    hyphen = lambda a: end(a).rlike(r"[\p{L}\p{N}_]-\s*$")
    zh = lambda a: end(a).rlike(T.CJK + "$") if lang != "zh" else F.lit(True)
    glue = lambda a, x: (
        F.when(x["l"], F.concat(a, F.lit("\n"), x["t"]))
        .when(hyphen(a), F.concat(F.regexp_replace(T.strip(a), r"-\s*$", ""), T.strip(x["t"])))
        .when(zh(a), F.concat(T.strip(a), T.strip(x["t"])))
        .otherwise(F.concat(T.strip(a), F.lit(" "), T.strip(x["t"])))
    )
    return grouped.groupBy(*keys, "_g").agg(F.min(F.struct(page, order)).alias("_first"), parts.alias("_p")).select(
        *keys, F.col(f"_first.{page}").alias(page), F.col(f"_first.{order}").alias("first_order"), F.size("_p").alias("n_blocks"),
        F.aggregate(F.slice("_p", 2, 1_000_000), F.element_at("_p", 1)["t"], glue).alias("content"),
    )


def list_groups(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with list_group: consecutive list items of one family (decimal and outline_decimal are one); others stand alone."""
    family = F.when(F.col("list_type") == "outline_decimal", "decimal").otherwise(F.col("list_type"))
    w = Window.partitionBy(*keys).orderBy(*order)
    f = blocks.withColumn("_f", F.when(F.col("list_type") != "", family))
    same = F.col("_f").isNotNull() & F.lag("_f").over(w).eqNullSafe(F.col("_f"))
    return islands(f, keys, order, ~same, "list_group").drop("_f")


def line_gap_groups(lines: DataFrame, keys: list[str], order: list[str], height: Column, top: str = "y0", bottom: str = "y1") -> DataFrame:
    """Lines with `para`: a gap of more than 1.4 line heights opens a paragraph."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(top) - F.lag(bottom).over(w)
    return islands(lines, keys, order, F.coalesce(gap > 1.4 * height, F.lit(True)), "para")


def running_lines(lines: DataFrame, doc: str, page: str, band: str, text: str) -> DataFrame:
    """Running headers and footers: texts of up to 120 characters that stand in the same margin band twice or more in 80 pages."""
    kept = lines.where((F.col(page) <= 80) & (F.length(text) <= 120) & F.col(band).isNotNull())
    return kept.groupBy(doc, band, text).agg(F.count("*").alias("n")).where("n >= 2").select(doc, band, text)


# Lines in the margins that are page numbers.
PAGE_NUMBER = r"(?i)^\s*(?:[-–—.]*\s*\d+\s*[-–—.]*|page\s+\d+(\s+of\s+\d+)?|\d+\s*/\s*\d+|第\s*\d+\s*页|[ivxlc]+)\s*$"


def without_running_lines(lines: DataFrame, doc: str, page: str, band: str, text: str) -> DataFrame:
    """lines without page numbers in the margins, nor running headers and footers."""
    body = lines.where(F.col(band).isNull() | ~F.col(text).rlike(PAGE_NUMBER))
    return body.join(running_lines(lines, doc, page, band, text), [doc, band, text], "left_anti").select(lines.columns)


# Blocks that are numbers of sections or pages.
SECTION_NUMBER, PAGE_ARTIFACT = r"^\d+(\.\d+)*\.?$", r"(?i)^(\d+|page\s+\d+(\s+of\s+\d+)?)$"


def without_page_artifacts(blocks: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Blocks without page numbers, and a lone section number joined with the short title that comes right after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = T.strip(F.coalesce(text, F.lit("")))
    after = F.lead(own).over(w)
    title = (after != "") & (F.length(after) < 120) & ~after.rlike(r"^[\d!|]")
    rows = blocks.withColumn("_own", own).withColumn("_after", after).withColumn("_joins", F.coalesce(own.rlike(SECTION_NUMBER) & title, F.lit(False)))
    rows = rows.withColumn("_taken", F.lag("_joins", 1, False).over(w))
    rows = rows.where((F.col("_own") != "") & ~F.col("_taken") & (F.col("_joins") | ~F.col("_own").rlike(PAGE_ARTIFACT)))
    return rows.withColumn(text, F.when(F.col("_joins"), F.concat_ws(" ", "_own", "_after")).otherwise(F.col("_own"))).select(blocks.columns)


#: Share of bold characters from which a line is bold.
BOLD = 0.85


def bold_ratio(spans: Column) -> Column:
    """Share of a line's characters, blanks apart, in bold spans (array of text, flags, font); 0 for a blank line."""
    size = lambda x: F.length(F.regexp_replace(x["text"], r"\s", ""))
    is_bold = lambda x: (x["flags"].bitwiseAND(16) > 0) | F.lower(x["font"]).contains("bold")
    total = F.aggregate(spans, F.lit(0), lambda n, x: n + size(x))
    bold = F.aggregate(spans, F.lit(0), lambda n, x: n + F.when(is_bold(x), size(x)).otherwise(0))
    return F.when(total > 0, bold / total).otherwise(0.0)


def body_font_size(spans: DataFrame, doc: str) -> DataFrame:
    """Most frequent font size by characters, over spans that aren't bold on the first 25 pages; the first seen of equals."""
    kept = spans.where((F.col("page") <= 25) & (F.col("flags").bitwiseAND(16) == 0) & (T.strip(F.col("text")) != ""))
    sizes = kept.groupBy(doc, F.round("size", 1).alias("size")).agg(F.sum(F.length(T.strip(F.col("text")))).alias("n"), F.min("ord").alias("first"))
    return sizes.groupBy(doc).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body_size"))


def line_pitch(lines: DataFrame, keys: list[str], order: list[str], body: Column) -> DataFrame:
    """Median distance of successive lines that are 8 to 80 apart; 1.35 times the body size if there are none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = F.col("y0") - F.lag("y0").over(w)
    out = lines.withColumn("_d", d).groupBy(*keys).agg(F.median(F.when((F.col("_d") > 8) & (F.col("_d") < 80), F.col("_d"))).alias("pitch"))
    return out.withColumn("pitch", F.coalesce("pitch", 1.35 * body))


def outside_tables(blocks: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """Blocks of which no table on their page covers more than 60 percent."""
    box = lambda p: {k: F.col(p + k) for k in ("x0", "y0", "x1", "y1")}
    renamed = tables.select(*(F.col(k).alias(f"_{k}") for k in page), *(F.col(k).alias(f"_t{k}") for k in ("x0", "y0", "x1", "y1")))
    same = F.lit(True)
    for k in page:
        same = same & (F.col(k) == F.col(f"_{k}"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return blocks.join(renamed, same & (T.rect_overlap(box(""), box("_t")) > 0.6 * area), "left_anti")


def toc_ranges(toc: DataFrame, doc: str, start: str, pages: str) -> DataFrame:
    """TOC entries with the last page of each: the one before the next entry starts, or the document's last."""
    w = Window.partitionBy(doc).orderBy(start)
    return toc.withColumn("end_page", F.greatest(F.col(start), F.coalesce(F.lead(start).over(w) - 1, F.col(pages))))


def assign_pages(pages: DataFrame, ranges: DataFrame, doc: str, page: str, start: str) -> DataFrame:
    """Pages joined to the TOC entry whose range holds them."""
    return pages.join(ranges, [pages[doc] == ranges[doc], pages[page].between(ranges[start], ranges["end_page"])]).drop(ranges[doc])


def scanned(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Whether a document is scanned: under 30 characters a page, on average, over the first ten pages."""
    return pages.where(F.col(page) <= 10).groupBy(doc).agg((F.avg(F.length(T.strip(F.coalesce(text, F.lit(""))))) < 30).alias("is_scanned"))


def paged(paragraphs: DataFrame, keys: list[str], order: list[str], per_page: int) -> DataFrame:
    """rows with page: so many rows to a page (22 paragraphs, or 50 lines)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return paragraphs.withColumn("page", (F.floor((n - 1) / per_page) + 1).cast("int"))


# --- folds whose decisions rest on accumulated text: over the rows of one page, as an array ---


def _folded(items: Column, joins, joined) -> Column:
    """Items of an array, each joined to the last one kept where joins(last, item) holds; joined(last, item) is both as one."""

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        both = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(joined(last, x)))
        return F.when(F.coalesce(joins(last, x), F.lit(False)), both).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, F.slice(items, F.lit(1), F.lit(0)), step)


def _glued(a: Column, b: Column) -> Column:
    return F.when(a.endswith("-"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))


def merge_short_blocks(blocks: DataFrame, doc: str, order: str, page: str, text: str) -> DataFrame:
    """doc, n, page, type, content: broken blocks of one page merged.

    First pass: a plain block that doesn't end a sentence takes the next plain one; second pass: so does one of under 140 characters
    or 22 words. Structural blocks are never merged, nor are blocks of two pages.
    """
    block = F.struct(
        order, T.block_type(F.col(text)).alias("type"), F.col(text).alias("content"), T.is_structural(F.col(text)).alias("structural"), T.is_sentence_terminal(F.col(text)).alias("terminal")
    )
    pages = blocks.groupBy(doc, F.col(page).alias("page")).agg(F.array_sort(F.collect_list(block)).alias("rows"))

    def merged(rows: Column, wants) -> Column:
        plain = lambda x: (x["type"] == "text") & ~x["structural"]
        return _folded(rows, lambda last, x: plain(last) & plain(x) & wants(last), lambda last, x: last.withField("content", _glued(last["content"], x["content"])).withField("terminal", x["terminal"]))

    short = lambda c: (F.length(c) < 140) | (F.regexp_count(c, F.lit(r"\S+")) < 22)
    once = pages.withColumn("rows", merged(F.col("rows"), lambda last: ~last["terminal"]))
    twice = once.withColumn("rows", merged(F.col("rows"), lambda last: short(last["content"])))
    each = twice.select(doc, "page", F.explode("rows").alias("b"))
    n = F.row_number().over(Window.partitionBy(doc).orderBy(f"b.{order}")) - 1
    return each.select(doc, n.alias("n"), "page", F.col("b.type").alias("type"), F.col("b.content").alias("content"))


def merged_tables(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, x0, y0, x1, y1: a page's table boxes by y0, x0, each joined to the one before if they overlap, or if over 65 percent of the
    width is common and the gap is under 80."""
    rows = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1"))).alias("rows"))

    def joins(a: Column, b: Column) -> Column:
        common, width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])
        touches = (common > 0) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"]))
        return touches | ((width > 0) & (common > 0.65 * width) & (b["y0"] - a["y1"] < 80))

    both = lambda a, b: F.struct(*(f(a[k], b[k]).alias(k) for k, f in (("y0", F.least), ("x0", F.least), ("x1", F.greatest), ("y1", F.greatest))))
    out = rows.select(*keys, F.posexplode(_folded(F.col("rows"), joins, both)).alias("n", "b"))
    return out.select(*keys, "n", *(F.col("b")[k].alias(k) for k in ("x0", "y0", "x1", "y1")))


def page_paragraphs(lines: DataFrame, keys: list[str], order: str, pitch: str) -> DataFrame:
    """keys, n, text: lines of each page (text, y0, is_heading, is_list, is_caption, terminal, and the page's line pitch) as paragraphs.

    The gap to the line before, in line pitches, decides with the accumulated text: up to 2.5 inside an open bracket, up to 2.2 in an
    unfinished sentence that no list item follows, up to 1.4 after a colon, up to 1.35 otherwise before what isn't a list item.
    A heading opens a paragraph; a caption ends one, and under the last two rules opens one too.
    """
    line = F.struct(order, "text", "y0", "is_heading", "is_list", "is_caption", "terminal", F.col(pitch).alias("pitch"))
    rows = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("rows"))
    more = lambda t, a, b: F.length(F.replace(t, F.lit(b), F.lit(""))) > F.length(F.replace(t, F.lit(a), F.lit("")))

    def joins(a: Column, b: Column) -> Column:
        gap = F.when(F.coalesce(a["pitch"], F.lit(0.0)) > 0, (b["y0"] - a["y0"]) / a["pitch"]).otherwise(0.0)
        opened = more(a["text"], "(", ")") | more(a["text"], "[", "]")
        colon = F.rtrim(a["text"]).rlike("[:：]$")
        free = ~b["is_heading"] & ~a["is_heading"] & ~a["is_caption"]
        near = (opened & (gap <= 2.5)) | (~a["terminal"] & ~b["is_list"] & (gap <= 2.2)) | (colon & (gap <= 1.4) & ~b["is_caption"]) | ((gap <= 1.35) & ~b["is_list"] & ~b["is_caption"])
        return free & near

    out = rows.select(*keys, F.posexplode(_folded(F.col("rows"), joins, lambda a, b: b.withField("text", _glued(a["text"], b["text"])))).alias("n", "b"))
    return out.select(*keys, "n", F.col("b.text").alias("text"))


def layout_blocks(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page, n, text: the paragraphs of a laid-out document, from its lines (doc, page, ord, text, y0, y1, band, size, body_size, bold).

    Page numbers, running headers and footers go; the rules on single lines are columns; then lines are joined page by page.
    """
    body = without_running_lines(lines, doc, "page", "band", "text")
    pitch = line_pitch(body.groupBy(doc, "page", "ord").agg(F.first("y0").alias("y0"), F.first("y1").alias("y1"), F.first("body_size").alias("body_size")), [doc, "page", "body_size"], ["ord"], F.col("body_size"))
    t, plain = F.col("text"), ~F.col("bold") & (F.col("size") < 1.14 * F.col("body_size"))
    told = body.join(pitch.select(doc, "page", "pitch"), [doc, "page"]).withColumns({
        "is_list": T.is_list_item(t) | T.is_bullet(t), "is_caption": T.is_caption(t), "terminal": T.is_sentence_terminal(t),
        "_follows": F.coalesce(F.lead(plain).over(Window.partitionBy(doc, "page").orderBy("ord")), F.lit(False)),
    })
    level = T.size_heading_level(F.col("size"), F.col("body_size"), F.col("bold"), t, F.col("is_list"), F.col("is_caption"), F.col("_follows"))
    told = told.withColumn("is_heading", level > 0)
    return page_paragraphs(told, [doc, "page"], "ord", "pitch")


def choose_splits(n_blocks: int, targets: list[tuple[str, int, int | None]], pages: list[int], score) -> list[tuple[int, str]]:
    """Blocks at which chapters start: (block, title), ascending.

    targets: (title, page, block or None) in order; pages: each block's page; score(target, block, on_page) is the confidence.
    The first chapter starts at block 0 under the first title. A target with a block needs no score. Others are looked for after
    the last split on their page and then, unless that scored SURE, on the pages beside it (the one before only among the last NEAR
    blocks, the one after only within NEAR of where the search starts). Starts stay MIN_BLOCKS apart.
    """
    if not targets:
        return []
    splits = [(0, targets[0][0])]
    on: dict[int, list[int]] = {}
    for i, p in enumerate(pages):
        on.setdefault(p, []).append(i)
    for k, (title, page, block) in enumerate(targets[1:], 1):
        start = splits[-1][0] + 1
        best, at = 0.0, None
        if block is not None:
            at, best = block, 1.0
        else:
            for on_page in (True, False):
                if not on_page and best >= SURE:
                    break
                before, after = on.get(page - 1, []), on.get(page + 1, [])
                near = on.get(page, []) if on_page else sorted([i for i in before[-NEAR:] if i >= n_blocks - NEAR] + after[bisect_left(after, start) : bisect_left(after, start + NEAR)])
                for i in near[bisect_left(near, start) :]:
                    s = score(k, i, on_page)
                    if s > best:
                        best, at = s, i
        if at is not None and best >= CONFIDENT and start <= at < n_blocks and at - splits[-1][0] >= MIN_BLOCKS:
            splits.append((at, title))
    return splits


def partition_chapters(blocks: DataFrame, targets: DataFrame, doc: str) -> DataFrame:
    """blocks (doc, ord, page, content, is_heading) with chapter_no and title, from targets (doc, n, title, start_page, block_idx).

    Confidences are columns over an equi-join (a target and the blocks on its page and the pages beside it); what a title or a block
    is compared by is found once for each, not for each pair. Only the ordered choice runs in Python.
    """
    near = F.explode(F.array(*(F.col("start_page") + i for i in (-1, 0, 1))))
    t = targets.select(doc, "n", "start_page", T.heading_parts(F.col("title")).alias("_t")).withColumn("page", near)
    own = T.strip(F.col("content"))
    b = blocks.select(doc, "ord", "page", "is_heading", T.heading_parts(T.first_line(own)).alias("_b"), T.is_heading(own).alias("_formed"))
    sim = T.parts_similarity(F.col("_t"), F.col("_b"))
    scored = b.join(t, [doc, "page"]).select(doc, "n", "ord", T.confidence(sim, F.col("is_heading"), F.col("_formed"), F.col("page") == F.col("start_page")).alias("conf"))
    scores = scored.where(F.col("conf") > 0).groupBy(doc).agg(F.collect_list(F.struct("n", "ord", "conf")).alias("scores"))
    lists = targets.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("n", "title", "start_page", "block_idx"))).alias("targets"))
    pages = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ord", "page"))).alias("pages"))
    per = pages.join(lists, doc).join(scores, doc, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, page_rows, target_rows, score_rows in zip(pdf[doc], pdf["pages"], pdf["targets"], pdf["scores"], strict=True):
                known = {(s["n"], s["ord"]): s["conf"] for s in (score_rows if score_rows is not None else [])}
                ords = [p["ord"] for p in page_rows]
                goals = [(g["title"], g["start_page"], None if pd.isna(g["block_idx"]) else int(g["block_idx"])) for g in target_rows]
                numbers = [g["n"] for g in target_rows]
                found = choose_splits(len(ords), goals, [p["page"] for p in page_rows], lambda k, i, _, known=known, numbers=numbers, ords=ords: known.get((numbers[k], ords[i]), 0.0))
                out += [(d, ords[at], no + 1, title) for no, (at, title) in enumerate(found)]
            yield pd.DataFrame(out, columns=[doc, "ord", "chapter_no", "title"])

    kind = blocks.schema[doc].dataType.simpleString()
    starts = per.mapInPandas(run, f"{doc} {kind}, ord int, chapter_no int, title string")
    w = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    led = blocks.join(starts, [doc, "ord"], "left")
    return led.withColumn("chapter_no", F.last("chapter_no", ignorenulls=True).over(w)).withColumn("title", F.last("title", ignorenulls=True).over(w))
