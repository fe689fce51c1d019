"""Batch translation that stops and goes on: results in a versioned table, each run takes what still needs one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import ERROR_MARK
from lectern.operators.status import is_translatable, needs_translation
from lectern.sinks.versions import VersionedTable

KEYS = ["doc_id", "id"]


def results_table(spark, path: str, paragraphs: DataFrame) -> VersionedTable:
    """A table of results for these paragraphs: doc_id, id, chinese, status (completed or error) and attempts."""
    kinds = {f.name: f.dataType.simpleString() for f in paragraphs.schema}
    return VersionedTable(spark, path, KEYS, f"doc_id {kinds['doc_id']}, id {kinds['id']}, chinese string, status string, attempts int")


def current(paragraphs: DataFrame, results: DataFrame) -> DataFrame:
    """paragraphs with the newest translation, status and attempts of each (0 where none was made)."""
    new = results.select(*KEYS, F.col("chinese").alias("_chinese"), F.col("status").alias("_status"), "attempts")
    both = paragraphs.join(new, KEYS, "left")
    return both.select(
        *(F.coalesce(f"_{c}", c).alias(c) if c in ("chinese", "status") else c for c in paragraphs.columns),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
    )


def translate_pending(
    paragraphs: DataFrame, table: VersionedTable, translate: Callable[[DataFrame], DataFrame], batch_of: Column | None = None, batches: int = 1,
    stop: Callable[[int], bool] = lambda done: False,
) -> int:
    """One run over the paragraphs whose newest translation is missing or failed; gives the number of batches that it published.

    translate sets `chinese` of the rows that it is given (a failed row: the error mark and why), in as many tasks as it has partitions. The
    paragraphs are dealt to batches by batch_of (a number from 0), each published when it is whole, and stop is asked before each: what was
    published stays, and the next run takes the rest and what failed. A run that dies within a batch loses that batch alone.
    """
    number = F.lit(0) if batch_of is None else batch_of
    for i in range(batches):
        if stop(i):
            return i
        todo = current(paragraphs, table.read()).where((number == i) & is_translatable() & needs_translation())
        done = translate(todo)
        failed = F.coalesce(F.col("chinese").startswith(ERROR_MARK), F.lit(True))
        table.save(done.select(
            *KEYS, F.coalesce("chinese", F.lit(ERROR_MARK + "]")).alias("chinese"), F.when(failed, "error").otherwise("completed").alias("status"),
            (F.col("attempts") + 1).cast("int").alias("attempts"),
        ))
    return batches


def run_status(paragraphs: DataFrame, results: DataFrame, stopped: bool) -> DataFrame:
    """doc_id, chapter_id, status, completed, failed and total of each chapter after a run: completed when all is translated, else error if
    some failed and none waits, else paused (after a stop) or pending. Only sound translations count."""
    ok, need = is_translatable(), needs_translation()
    counts = current(paragraphs, results).groupBy("doc_id", "chapter_id").agg(
        F.count_if(ok & ~need).alias("completed"), F.count_if(ok & need & (F.col("status") == "error")).alias("failed"), F.count_if(ok).alias("total"),
    )
    waits = F.col("completed") + F.col("failed") < F.col("total")
    status = F.when(F.col("completed") == F.col("total"), "completed").when(~waits, "error").otherwise("paused" if stopped else "pending")
    return counts.select("doc_id", "chapter_id", status.alias("status"), "completed", "failed", "total")
