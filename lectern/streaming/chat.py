"""Streams: model answers put together from chunks, and reading progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = "chat string, seq bigint, line string"


def chunk_of(line: Column) -> Column:
    """Text of one line of a model's stream: 'data: {json}' of either vocabulary, or plain JSON lines; null for what can't be read."""
    body = F.regexp_replace(F.trim(line), r"^data:\s*", "")
    json = F.from_json(body, "choices array<struct<delta:struct<content:string>>>, message struct<content:string>, response string, content string")
    return F.coalesce(F.get(json["choices"], 0)["delta"]["content"], json["message"]["content"], json["response"], json["content"])


def is_done(line: Column) -> Column:
    """Whether a line ends its answer."""
    body = F.regexp_replace(F.trim(line), r"^data:\s*", "")
    return (body == "[DONE]") | F.coalesce(F.get_json_object(body, "$.done") == "true", F.lit(False))


def decoded(lines: DataFrame) -> DataFrame:
    """chat, seq, delta and done of stream lines (chat, seq, line); lines that can't be read are dropped."""
    rows = lines.select("chat", "seq", chunk_of(F.col("line")).alias("delta"), is_done(F.col("line")).alias("done"))
    return rows.where(F.col("done") | F.col("delta").isNotNull())


def answers(chunks: DataFrame) -> DataFrame:
    """chat and content of whole answers, from a table of chunks: those that ended, and what there is of others."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return chunks.groupBy("chat").agg(F.array_join(F.transform(parts, lambda x: x["delta"]), "").alias("content"), F.max("done").alias("complete"))


PARTS = "array<struct<seq: bigint, epoch: bigint, delta: string>>"


def whole_answers(chunks: DataFrame) -> DataFrame:
    """chat, parts, finish and whole, from chunks (chat, seq, epoch, delta, finish: the number of the end, where it is known).

    Of chunks with one number the earliest counts. An answer is whole when its end has come and no number is missing before it.
    """
    parts = F.sort_array(F.collect_list(F.struct("seq", "epoch", "delta")))
    each = chunks.groupBy("chat").agg(parts.alias("_all"), F.max("finish").alias("finish"))
    own = each.withColumn("parts", F.filter("_all", lambda x, i: (i == 0) | (F.get(F.col("_all"), i - 1)["seq"] != x["seq"]))).drop("_all")
    known = F.size(F.filter("parts", lambda x: x["seq"] <= F.col("finish")))
    return own.withColumn("whole", F.coalesce(known == F.col("finish") + 1, F.lit(False)))


def run_answers(chunks: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream of chunks over what there is; chat and content, once for each answer when it is whole.

    Chunks (chat, seq from 0, delta, done) may come in any order and twice. Each batch puts together its own and those that wait, and
    writes what still waits beside the answers, by epoch: a restart goes on where it was, and an epoch that runs again
    writes the same rows in the same place.
    """
    table = chunks.sparkSession.read.schema(f"chat string, content string, parts {PARTS}, finish bigint, whole boolean")

    def put_together(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("chat", "seq", F.lit(epoch).cast("long").alias("epoch"), F.coalesce("delta", F.lit("")).alias("delta"), F.when(F.col("done"), F.col("seq")).alias("finish"))
        if epoch > 0:
            waits = table.parquet(f"{path}/epoch={epoch - 1}").where("not whole")
            rows = rows.unionByName(waits.select("chat", "finish", F.inline("parts")))
        text = F.array_join(F.transform(F.filter("parts", lambda x: x["seq"] <= F.col("finish")), lambda x: x["delta"]), "")
        done = F.col("whole")
        made = whole_answers(rows).select("chat", F.when(done, text).alias("content"), F.when(~done, F.col("parts")).alias("parts"), "finish", "whole")
        made.write.mode("overwrite").partitionBy("whole").parquet(f"{path}/epoch={epoch}")

    chunks.writeStream.foreachBatch(put_together).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.parquet(path).where("whole").select("chat", "content")


def stream_progress(events: DataFrame) -> DataFrame:
    """doc, chapter, best and completed after each batch of events (doc, chapter, ratio): progress never falls, and 95 counts as all."""
    ratio = F.nanvl("ratio", F.lit(None).cast("double"))
    r = F.when(ratio.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(ratio + 0.5)))).cast("int")
    best = F.coalesce(F.max(F.when(r >= 95, 100).otherwise(r)), F.lit(0)).alias("best")
    return events.groupBy("doc", "chapter").agg(best).select("doc", "chapter", "best", (F.col("best") >= 100).alias("completed"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what there is, to a Parquet table (append), or the last value of each key (update)."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
