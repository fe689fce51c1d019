"""Queries on streams: run over files with a trigger that ends when all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.cards import _SM2
from lectern.sinks.versions import shared_folder
from lectern.sources import derive as D
from lectern.streaming import chat as S
from lectern.streaming import progress as P
from lectern.streaming import reviews as R


def _folder(spark) -> str:
    return shared_folder(spark, "stream")


def _lines(spark, sf_dir):
    chat = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chat")
    m = D.messages(spark, sf_dir).where("content is not null").select(chat, F.split("content", " ").alias("words"))
    words = m.select("chat", F.posexplode("words").alias("seq", "w"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat("w", F.lit(" ")).alias("content")).alias("delta"))).alias("choices")))
    chunks = words.select("chat", F.col("seq").cast("long").alias("seq"), F.concat(F.lit("data: "), body).alias("line"))
    ends = m.groupBy("chat").agg(F.max(F.size("words")).cast("long").alias("seq")).select("chat", "seq", F.lit("data: [DONE]").alias("line"))
    return chunks.unionByName(ends)


def stream_concat_messages(spark, sf_dir):
    base = _folder(spark)
    files = -(-spark.sparkContext.defaultParallelism // 3)  # of each batch, of three
    _lines(spark, sf_dir).repartition(3 * files, "chat", "seq").write.parquet(f"{base}/in")
    source = spark.readStream.schema(S.CHUNKS).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    return S.run_answers(S.decoded(source), f"{base}/out", f"{base}/check")


def stream_progress_best(spark, sf_dir):
    base = _folder(spark)
    e = D.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc"), F.col("event_type").alias("chapter"), (F.abs("value") % 120).alias("ratio"))
    e.repartition(3).write.parquet(f"{base}/in")
    source = spark.readStream.schema("doc string, chapter string, ratio double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = S.run_available(S.stream_progress(source), f"{base}/out", f"{base}/check", "update")
    return out.groupBy("doc", "chapter").agg(F.max_by("best", "epoch").alias("best"), F.max_by("completed", "epoch").alias("completed"))


def stream_reviews(spark, sf_dir):
    """All reviews as a stream of files in no order of time; the last state of each card."""
    base = _folder(spark)
    log = D.reviews(spark, sf_dir).select("user_id", F.col("rating").cast("int").alias("rating"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("no"))
    log.repartition(3, "no").write.parquet(f"{base}/in")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return R.last_states(R.run_reviews(source, "user_id", f"{base}/out", f"{base}/check"), "user_id")


def progress_events(spark, sf_dir):
    """Events as a stream of three files with observed counts; the listener's table of batches, summed by observation."""
    base = _folder(spark)
    e = D.read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    e.repartition(3, "event_id").write.parquet(f"{base}/in")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    seen = source.observe("seen", F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    with P.listening(spark) as log:
        S.run_available(seen, f"{base}/out", f"{base}/check")
    counts = F.from_json("metrics", "n long, clicks long")
    return log.table(spark).select("name", "rows", counts.alias("m")).groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("m.n").alias("n"), F.sum("m.clicks").alias("clicks"))


QUERIES = {f.__name__: f for f in (stream_concat_messages, stream_progress_best, stream_reviews, progress_events)}

ORACLES = {k: D.duck(v) for k, v in {
    "progress_events": "select 'seen' as name, count(*) as rows, count(*) as n, count(*) filter (event_type = 'click') as clicks from events",
    "stream_reviews": f"select * from {_SM2} t",
    "stream_concat_messages": "select concat(cast(conv_id as string), '_', cast(turn as string)) as chat, concat(content, ' ') as content from {messages} m",
    "stream_progress_best": "select doc, chapter, best, best >= 100 as completed from (select cast(user_id as string) as doc, event_type as chapter, max(case when r >= 95 then 100 else r end) as best from (select *, cast(greatest(0, least(100, floor(abs(value) % 120 + 0.5))) as int) as r from events) t group by 1, 2) u",
}.items()}
