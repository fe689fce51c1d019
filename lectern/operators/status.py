"""Translation status, counts, failed chapters, digests and reading progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ERROR_MARK, percent

FAILED_MARKS = ("抓取此章节内容时超时", "遇到网络错误")
DIGEST_CHARS = 2500


def is_translatable() -> Column:
    return ~F.col("type").isin("image", "code") & ~F.coalesce("no_translate", F.lit(False))


def needs_translation() -> Column:
    return (F.coalesce("status", F.lit("")) != "completed") | F.coalesce(F.col("chinese").startswith(ERROR_MARK), F.lit(False))


def _done() -> Column:
    return (F.col("status") == "completed") & ~F.coalesce(F.col("chinese").startswith(ERROR_MARK), F.lit(False))


def _totals(done: Column, total: Column) -> list[Column]:
    return [
        F.when((done >= total) & (total > 0), "completed").otherwise("idle").alias("status"), done.alias("completed"), total.alias("total"),
        F.greatest(F.lit(0).cast("long"), total - done).alias("untranslated"), F.when(total == 0, 100).otherwise(percent(done, total)).alias("percent"),
    ]


def chapter_status(paragraphs: DataFrame) -> DataFrame:
    """Status of each chapter; one without translatable paragraphs is at 100 percent."""
    ok = is_translatable()
    counts = paragraphs.groupBy("doc_id", "chapter_id").agg(F.count_if(ok & _done()).alias("_done"), F.count_if(ok).alias("_total"))
    return counts.select("doc_id", "chapter_id", *_totals(F.col("_done"), F.col("_total")))


def document_status(chapters: DataFrame) -> DataFrame:
    """Rollup of chapter_status."""
    counts = chapters.groupBy("doc_id").agg(F.sum("completed").alias("_done"), F.sum("total").alias("_total"), F.count("*").alias("total_chapters"))
    return counts.select("doc_id", *_totals(F.col("_done"), F.col("_total")), "total_chapters")


def recount(paragraphs: DataFrame) -> DataFrame:
    """Paragraph and translated counts of chapters (level 'chapter') and documents ('document'), in one pass.

    status_completed counts the status alone; effective_completed leaves failed translations out.
    """
    return (
        paragraphs.rollup("doc_id", "chapter_id")
        .agg(F.count("*").alias("paragraph_count"), F.count_if(F.col("status") == "completed").alias("status_completed"), F.count_if(_done()).alias("effective_completed"), F.grouping_id().alias("_g"))
        .where("_g < 3")
        .select("doc_id", "chapter_id", F.when(F.col("_g") == 1, "document").otherwise("chapter").alias("level"), "paragraph_count", "status_completed", "effective_completed")
    )


def failed_chapters(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc_id, has_missing_or_failed and failed_count of web documents.

    documents: doc_id, file_type, source_url, status, n_selected. chapters: doc_id, fetch_success, paragraph_count, head.
    """
    head = F.left(F.coalesce("head", F.lit("")), F.lit(200))
    marked = (F.coalesce("paragraph_count", F.lit(0)) <= 2) & (head.contains(FAILED_MARKS[0]) | head.contains(FAILED_MARKS[1]))
    bad = chapters.groupBy("doc_id").agg(F.count("*").alias("_n"), F.count_if(F.coalesce(~F.col("fetch_success"), F.lit(False)) | marked).alias("_bad"))
    web = (F.col("file_type") == "web") | (F.coalesce("source_url", F.lit("")) != "")
    n, short = F.coalesce("_n", F.lit(0)), F.col("n_selected") - F.coalesce("_n", F.lit(0))
    count = (
        F.when(~web, 0)
        .when(F.col("status").isin("error", "extracting"), F.when(F.col("n_selected") > 0, F.greatest(F.lit(1), short)).otherwise(1))
        .when(F.col("n_selected") > n, short)
        .otherwise(F.coalesce("_bad", F.lit(0)))
        .cast("long")
    )
    return documents.join(bad, "doc_id", "left").select("doc_id", (count > 0).alias("has_missing_or_failed"), count.alias("failed_count"))


def refetch_targets(chapters: DataFrame, selected: DataFrame) -> DataFrame:
    """Failed chapters with the URL to fetch: their own, or the first selected one of the same title."""
    first = selected.groupBy("doc_id", "title").agg(F.min_by("url", "index").alias("_url"))
    return chapters.where(~F.col("fetch_success")).join(first, ["doc_id", "title"], "left").withColumn("url", F.coalesce(F.nullif("url", F.lit("")), "_url")).drop("_url")


def digest_status(chapters: DataFrame, digests: DataFrame, text: str = "body") -> DataFrame:
    """Per document: chapters, those whose digest is current or that need none, and those that need one."""
    long = F.length(text) > DIGEST_CHARS
    hashed = chapters.withColumn("source_hash", F.sha2(F.col(text).cast("binary"), 256))
    have = digests.select("doc_id", "chapter_id", "source_hash", F.lit(True).alias("_have")).distinct()
    both = hashed.join(have, ["doc_id", "chapter_id", "source_hash"], "left")
    return both.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(~long | F.col("_have").isNotNull()).alias("ready"), F.count_if(long).alias("compressed"))


def digest_misses(chapters: DataFrame, digests: DataFrame, text: str = "body") -> DataFrame:
    """Long chapters without a digest of their present text: all that has to be computed."""
    hashed = chapters.where(F.length(text) > DIGEST_CHARS).withColumn("source_hash", F.sha2(F.col(text).cast("binary"), 256))
    return hashed.join(digests.select("doc_id", "chapter_id", "source_hash"), ["doc_id", "chapter_id", "source_hash"], "left_anti")


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def weighted_progress(chapters: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress of documents: mean of chapters by paragraphs, or the plain mean if any chapter has none.

    chapters: doc_id, chapter_id, paragraph_count. progress: doc_id, chapter_id, ratio (missing: 0).
    """
    p, n = F.coalesce("ratio", F.lit(0)), F.coalesce("paragraph_count", F.lit(0))
    both = chapters.join(progress, ["doc_id", "chapter_id"], "left").groupBy("doc_id")
    sums = both.agg(F.sum(p * n).alias("_w"), F.sum(n).alias("_n"), F.min(n).alias("_min"), F.avg(p).alias("_mean"))
    return sums.select("doc_id", js_round(F.when((F.col("_min") > 0) & (F.col("_n") > 0), F.col("_w") / F.col("_n")).otherwise(F.col("_mean"))).cast("int").alias("progress"))


def with_progress(documents: DataFrame, progress: DataFrame) -> DataFrame:
    """documents with `progress`: 100 for those that are completed or at 100 and more, else their ratio; null where nothing was read.

    progress: doc_id, ratio, completed; of several rows for a document the furthest counts.
    """
    value = F.when(F.coalesce("completed", F.lit(False)) | (F.col("ratio") >= 100), F.lit(100.0)).otherwise(F.col("ratio").cast("double"))
    return documents.join(progress.groupBy("doc_id").agg(F.max(value).alias("progress")), "doc_id", "left")


def running_progress(events: DataFrame, keys: list[str], order: list[str], ratio: str) -> DataFrame:
    """Events with `best`, the highest progress so far (95 and more counts as 100), and `completed`, once it is 100."""
    raw = F.greatest(F.lit(0), F.least(F.lit(100), js_round(F.col(ratio)).cast("int")))
    value = F.when(raw >= 95, 100).otherwise(raw)
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("best", F.max(value).over(so_far)).withColumn("completed", F.col("best") >= 100)
