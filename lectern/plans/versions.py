"""Queries on tables in versions: translation that fails, stops and goes on; documents taken in anew while others read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import translation as T
from lectern.sinks.versions import VersionedTable, shared_folder
from lectern.sources import derive as D

_C = F.col
_MARK = "[翻译调用异常"


def _runs(spark, sf_dir):
    """Three runs over all paragraphs: half of the batches with calls that time out, the rest after a mend, and once more."""
    base = shared_folder(spark, "translation")
    paragraphs = D.paragraphs(spark, sf_dir)
    paragraphs.write.parquet(f"{base}/paragraphs")
    paragraphs = spark.read.schema(paragraphs.schema).parquet(f"{base}/paragraphs")
    table = T.results_table(spark, f"{base}/results", paragraphs)

    def failing(n):
        said = F.when(_C("ord") % n == 1, F.concat(F.lit(_MARK + ": timeout "), _C("attempts").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("译:"), "english"))
        return lambda todo: todo.withColumn("chinese", said)

    by = _C("doc_id") % 4
    T.translate_pending(paragraphs, table, failing(3), by, 4, stop=lambda done: done == 2)
    stopped = T.run_status(paragraphs, table.read(), stopped=True)
    T.translate_pending(paragraphs, table, failing(9), by, 4)
    T.translate_pending(paragraphs, table, failing(9), by, 4)
    return paragraphs, table, stopped


def translation_resumed(spark, sf_dir):
    paragraphs, table, _ = _runs(spark, sf_dir)
    return T.current(paragraphs, table.read()).select("doc_id", "id", "chinese", "status", "attempts")


def translation_runs(spark, sf_dir):
    paragraphs, table, stopped = _runs(spark, sf_dir)
    after = T.run_status(paragraphs, table.read(), stopped=False)
    return stopped.withColumn("after", F.lit("stop")).unionByName(after.withColumn("after", F.lit("all runs")))


def reingested_documents(spark, sf_dir):
    """Chapters of all documents; every second document is taken in again, every fourth once more by a writer that dies before it publishes
    and then by one that doesn't. What readers see at each point."""
    table = VersionedTable(spark, shared_folder(spark, "library"), ["doc_id", "chapter_id"])
    joined = F.transform(F.array_sort(F.collect_list(F.struct("ord", "english"))), lambda x: x["english"])
    chapters = D.paragraphs(spark, sf_dir).groupBy("doc_id", "chapter_id").agg(F.concat_ws("\n", joined).alias("body"), F.count("*").alias("paragraph_count"))
    table.save(chapters.withColumn("revision", F.lit(1)), "replace")
    again = lambda n, revision, body: table.read().where(_C("doc_id") % n == 0).withColumn("body", body).withColumn("revision", F.lit(revision))
    table.upsert(again(2, 2, F.concat(F.lit("anew "), "body")))
    lost = table.write(again(4, 3, F.concat(F.lit("lost "), "body")))
    during = table.read().withColumn("seen", F.lit("between write and publish"))
    table.upsert(again(4, 4, F.concat(_C("body"), F.lit(" refetched"))))
    after = table.read().withColumn("seen", F.lit("at last"))
    assert lost.folder in table.vacuum()
    return during.unionByName(after).select("seen", "doc_id", "chapter_id", "revision", "paragraph_count", "body")


QUERIES = {f.__name__: f for f in (translation_resumed, translation_runs, reingested_documents)}

_STATE = """(select *, ok and (status <> 'completed' or starts_with(chinese, '[翻译调用异常')) as need from (select *, type not in ('image', 'code') and not no_translate as ok from {paragraphs} p) q)"""

ORACLES = {k: D.duck(v) for k, v in {
    "translation_resumed": f"""select doc_id, id,
        case when not need then chinese when ord % 9 = 1 then concat('[翻译调用异常: timeout ', cast(case when doc_id % 4 < 2 then 2 else 1 end as varchar), ']') else concat('译:', english) end as chinese,
        case when not need then status when ord % 9 = 1 then 'error' else 'completed' end as status,
        cast(case when not need then 0 when ord % 9 = 1 then case when doc_id % 4 < 2 then 3 else 2 end when doc_id % 4 < 2 and ord % 3 = 1 then 2 else 1 end as int) as attempts from {_STATE} s""",
    "translation_runs": f"""with s as (select *, need and ord % 9 = 1 as dead, need and (doc_id % 4 >= 2) as waits, need and doc_id % 4 < 2 and ord % 3 = 1 as failed from {_STATE} s),
        c as (select doc_id, chapter_id, count(*) filter (ok and not waits and not failed) as completed, count(*) filter (failed) as failed, count(*) filter (ok) as total, 'stop' as after from s group by doc_id, chapter_id
          union all select doc_id, chapter_id, count(*) filter (ok and not dead), count(*) filter (dead), count(*) filter (ok), 'all runs' from s group by doc_id, chapter_id)
        select doc_id, chapter_id, case when completed = total then 'completed' when completed + failed = total then 'error' when after = 'stop' then 'paused' else 'pending' end as status, completed, failed, total, after from c""",
    "reingested_documents": """with c as (select doc_id, chapter_id, string_agg(english, chr(10) order by ord) as body, count(*) as paragraph_count from {paragraphs} p group by doc_id, chapter_id),
        s as (select unnest(['between write and publish', 'at last']) as seen)
        select seen, doc_id, chapter_id, cast(case when doc_id % 2 <> 0 then 1 when doc_id % 4 = 0 and seen = 'at last' then 4 else 2 end as int) as revision, paragraph_count,
          case when doc_id % 2 <> 0 then body when doc_id % 4 = 0 and seen = 'at last' then concat('anew ', body, ' refetched') else concat('anew ', body) end as body from c, s""",
}.items()}
