"""Context windows, readable texts and chat histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clipped, strip

DOCUMENT_CHARS, CHAPTER_CHARS = 24_000, 16_000
CUT_MARK = "\n\n[...]"


def frame_by_position(rows: DataFrame, keys: list[str], order: list[str], value: str, before: int = 2, after: int = 2) -> DataFrame:
    """rows with `frame`: the values of the neighbours by position, itself included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return rows.withColumn("frame", F.collect_list(value).over(w))


def frame_nonblank(rows: DataFrame, keys: list[str], order: str, value: str, before: int = 2, after: int = 2) -> DataFrame:
    """rows with `before` and `after`: the nearest non-blank values on either side, in reading order.

    Blank rows don't use up places: each row has the rank of the last non-blank row up to it, and frames are taken in ranks.
    """
    solid = F.coalesce(strip(F.col(value)), F.lit("")) != ""
    w = Window.partitionBy(*keys).orderBy(order)
    ranked = rows.withColumn("_solid", solid).withColumn("_rank", F.sum(solid.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.when(F.col("_solid"), F.col(value))
    by_rank = Window.partitionBy(*keys).orderBy("_rank")
    start = F.when(F.col("_solid"), 1).otherwise(0)
    past = F.collect_list(F.struct(F.col("_rank").alias("r"), text.alias("t"))).over(by_rank.rangeBetween(-before, 0))
    future = F.collect_list(F.struct(F.col("_rank").alias("r"), text.alias("t"))).over(by_rank.rangeBetween(0, after + 0))
    cleaned = lambda c, low, high: F.transform(F.array_sort(F.filter(c, lambda x: x["t"].isNotNull() & (x["r"] >= low) & (x["r"] <= high))), lambda x: x["t"])
    r = F.col("_rank")
    out = ranked.withColumn("before", cleaned(past, r - start - (before - 1), r - start)).withColumn("after", cleaned(future, r + 1, r + after))
    return out.drop("_solid", "_rank")


def last_readable(rows: DataFrame, keys: list[str], order: str, value: str, extra: list[str]) -> DataFrame:
    """rows with `previous`: the nearest readable row before (text or scanned page, not blank), as a struct of value and extra."""
    ok = F.col("type").isin("text", "scanned_page") & (F.coalesce(strip(F.col(value)), F.lit("")) != "")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(F.when(ok, F.struct(value, *extra)), ignorenulls=True).over(w))


def is_image() -> Column:
    """Whether a paragraph is, or holds, an image."""
    return F.coalesce(F.col("type").isin("scanned_page", "image"), F.lit(False)) | (F.coalesce("image_url", F.lit("")) != "") | F.coalesce(F.col("english").contains("!["), F.lit(False))


def needs_extraction(force: bool = False) -> Column:
    """Images whose text hasn't been read yet, or all of them."""
    return is_image() & (F.lit(force) | (F.coalesce("extracted_text", F.lit("")) == ""))


def ordered_text(order: str, text: Column, separator: str = "\n\n") -> Column:
    """Aggregate: texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def _kept_text(order: str, text: Column) -> Column:
    """ordered_text of the texts that aren't null."""
    rows = F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["t"]), "\n\n")


def readable_units(rows: DataFrame, keys: list[str], order: str, english: str = "english", chinese: str = "chinese", extracted: str = "extracted_text") -> DataFrame:
    """rows that are readable, with `unit`, their numbered text; images count even without text."""
    src, trans, seen = (strip(F.coalesce(c, F.lit(""))) for c in (english, chinese, extracted))
    image = F.col("type").isin("scanned_page", "image") | src.contains("![")
    content = F.when(seen != "", seen).when((trans != "") & ~trans.startswith("[OCR"), trans).otherwise("")
    kept = rows.where(image | (src != ""))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("string")
    unit = (
        F.when(image & (content != ""), F.concat(F.lit("[第 "), n, F.lit(" 单元: 图文内容]:\n"), content))
        .when(image, F.concat(F.lit("[第 "), n, F.lit(" 单元: 幻灯片图片]")))
        .when(trans != "", F.concat(F.lit("[第 "), n, F.lit(" 段]: "), src, F.lit("\n[译文/精读]: "), trans))
        .otherwise(F.concat(F.lit("[第 "), n, F.lit(" 段]: "), src))
    )
    return kept.withColumn("unit", unit)


def chapter_text(rows: DataFrame, keys: list[str], order: str, **columns: str) -> DataFrame:
    """keys, body and char_count of each chapter."""
    body = readable_units(rows, keys, order, **columns).groupBy(*keys).agg(ordered_text(order, F.col("unit")).alias("body"))
    return body.withColumn("char_count", F.length("body"))


def document_context(chapters: DataFrame, order: str, title: str, body: str, budget: int = DOCUMENT_CHARS) -> DataFrame:
    """Per document: chapters, their characters, and their texts in order, cut to the budget.

    The running length is a window over lengths alone; only the texts that start within the budget are then read and joined, so no text is
    sorted and no string grows beyond the budget and one text.
    """
    part = F.concat(F.lit("## "), F.col(title), F.lit("\n"), F.col(body))
    sizes = chapters.select("doc_id", order, F.length(part).alias("_n"), F.length(body).alias("_chars"))
    before = F.coalesce(F.sum(F.col("_n") + 2).over(Window.partitionBy("doc_id").orderBy(order, "_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("_before", before).where(F.col("_before") <= budget + 2).select(F.col("doc_id").alias("_d"), F.col(order).alias("_o")).distinct()
    texts = chapters.withColumn("_part", part).join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col(order).eqNullSafe(F.col("_o")), "left_semi")
    texts = texts.groupBy(F.col("doc_id").alias("_d")).agg(_kept_text(order, F.col("_part")).alias("_all"))
    counts = sizes.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.sum("_chars").alias("original_chars"))
    both = counts.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return both.select("doc_id", "chapters", "original_chars", clipped(F.col("_all"), budget, CUT_MARK).alias("context"))


def rule_digest(title: Column, body: Column) -> Column:
    """Digest without a model: the first eight lines that are headings, numbered units or longer than 40 characters."""
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda s: s.startswith("#") | s.startswith("[第") | (F.length(s) > 40))
    points = F.transform(F.slice(lines, 1, 8), lambda s: F.concat(F.lit("- "), F.left(s, F.lit(120))))
    return F.concat(F.lit("### 《"), title, F.lit("》要点摘要 (快速提取)\n\n"), F.array_join(points, "\n"))


def chat_tail(messages: DataFrame, chat: str, order: str, n: int = 30) -> DataFrame:
    """Valid messages among the last n of each chat."""
    last = Window.partitionBy(chat).orderBy(F.col(order).desc())
    tail = messages.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")
    return tail.where(F.col("role").isin("user", "assistant") & (F.coalesce(strip(F.col("content")), F.lit("")) != ""))


def delete_with_partner(messages: DataFrame, doomed: DataFrame, chat: str, order: str) -> DataFrame:
    """messages without the doomed (chat, order) and their partners: an answer takes the nearest question before it along, a question the
    nearest answer after it."""
    flagged = messages.join(doomed.select(chat, order, F.lit(True).alias("_gone")).distinct(), [chat, order], "left")
    w = Window.partitionBy(chat).orderBy(order)
    pos = F.col(order)
    past = F.last(F.when(F.col("role") == "user", pos), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    future = F.first(F.when(F.col("role") == "assistant", pos), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    partner = F.when(F.col("_gone") & (F.col("role") == "assistant"), past).when(F.col("_gone") & (F.col("role") == "user"), future)
    out = flagged.withColumn("_partner", partner)
    taken = out.where("_partner is not null").select(chat, F.col("_partner").alias(order)).distinct()
    return out.where("_gone is null").drop("_gone", "_partner").join(taken, [chat, order], "left_anti")
