"""Queries on translation status, counts, failed chapters, digests and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import status as S
from lectern.sources import derive as D


def translation_status_chapter(spark, sf_dir):
    return S.chapter_status(D.paragraphs(spark, sf_dir))


def translation_status_document(spark, sf_dir):
    return S.document_status(S.chapter_status(D.paragraphs(spark, sf_dir)))


def translation_pending(spark, sf_dir):
    return D.paragraphs(spark, sf_dir).where(S.is_translatable() & S.needs_translation()).select("doc_id", "id", "english")


def meta_recount(spark, sf_dir):
    return S.recount(D.paragraphs(spark, sf_dir))


def failed_chapters(spark, sf_dir):
    p = D.read(spark, sf_dir, "pages")
    n = F.col("page_id")
    docs = p.select(n.alias("doc_id"), F.when(n % 5 == 4, "pdf").otherwise("web").alias("file_type"), F.lit("").alias("source_url"), F.when(n % 11 == 0, "error").when(n % 13 == 0, "extracting").otherwise("completed").alias("status"), F.when(n % 3 == 0, 4).otherwise(0).cast("long").alias("n_selected"))
    chapters = p.select(n.alias("doc_id"), F.explode(F.sequence(F.lit(0), (n % 4).cast("int"))).alias("k")).select(
        "doc_id", "k", F.when((F.col("doc_id") + F.col("k")) % 6 == 0, F.lit(False)).otherwise(F.lit(True)).alias("fetch_success"), (F.col("k") + 1).alias("paragraph_count"),
        F.when((F.col("doc_id") + F.col("k")) % 7 == 0, "> 抓取此章节内容时超时").otherwise("text").alias("head"),
    )
    return S.failed_chapters(docs, chapters)


def digest_status(spark, sf_dir):
    chapters, digests = _digests(spark, sf_dir)
    return S.digest_status(chapters, digests)


def _digests(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents")
    chapters = d.select((F.col("doc_id") % 20).alias("doc_id"), F.col("doc_id").cast("string").alias("chapter_id"), F.col("text").alias("body"))
    digests = d.where("doc_id % 2 = 0").select((F.col("doc_id") % 20).alias("doc_id"), F.col("doc_id").cast("string").alias("chapter_id"), F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("source_hash"))
    return chapters, digests


def digest_cache_miss(spark, sf_dir):
    chapters, digests = _digests(spark, sf_dir)
    return S.digest_misses(chapters, digests).select("doc_id", "chapter_id", "source_hash")


def weighted_progress(spark, sf_dir):
    e = D.read(spark, sf_dir, "events")
    ratio = e.groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("chapter_id")).agg(F.max(F.floor(F.abs("value")) % 101).alias("ratio"))
    kinds = e.select(F.col("user_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view", "other")))).alias("chapter_id"))
    chapters = kinds.withColumn("paragraph_count", F.when((F.col("doc_id") % 3 == 0) & (F.col("chapter_id") == "view"), 0).otherwise(F.length("chapter_id")))
    return S.weighted_progress(chapters, ratio)


def progress_running_max(spark, sf_dir):
    e = D.read(spark, sf_dir, "events").withColumn("ratio", F.abs("value") % 120)
    return S.running_progress(e, ["user_id", "event_type"], ["ts", "event_id"], "ratio").select("event_id", "user_id", "best", "completed")


QUERIES = {f.__name__: f for f in (
    translation_status_chapter, translation_status_document, translation_pending, meta_recount, failed_chapters, digest_status, digest_cache_miss, weighted_progress, progress_running_max,
)}

_OK, _DONE = "type not in ('image', 'code') and not no_translate", "status = 'completed' and not starts_with(chinese, '[翻译调用异常')"
_CH = f"(select doc_id, chapter_id, count(*) filter ({_OK} and {_DONE}) as c, count(*) filter ({_OK}) as n from {{paragraphs}} p group by doc_id, chapter_id)"
_STATUS = "case when c >= n and n > 0 then 'completed' else 'idle' end as status, c as completed, n as total, n - c as untranslated, cast(case when n = 0 then 100 else floor(c * 100 / n) end as int) as percent"

ORACLES = {k: D.duck(v) for k, v in {
    "translation_status_chapter": f"select doc_id, chapter_id, {_STATUS} from {_CH} t",
    "translation_status_document": f"select doc_id, {_STATUS}, k as total_chapters from (select doc_id, cast(sum(c) as bigint) as c, cast(sum(n) as bigint) as n, count(*) as k from {_CH} t group by doc_id) u",
    "translation_pending": f"select doc_id, id, english from {{paragraphs}} p where {_OK} and (status <> 'completed' or starts_with(chinese, '[翻译调用异常'))",
    "meta_recount": f"""select doc_id, chapter_id, case when grouping(chapter_id) = 1 then 'document' else 'chapter' end as level, count(*) as paragraph_count, count(*) filter (status = 'completed') as status_completed,
        count(*) filter ({_DONE}) as effective_completed from {{paragraphs}} p group by rollup (doc_id, chapter_id) having grouping(doc_id) = 0""",
    "failed_chapters": """with d as (select page_id as doc_id, page_id % 5 <> 4 as web, page_id % 11 = 0 or page_id % 13 = 0 as stalled, case when page_id % 3 = 0 then 4 else 0 end as sel from pages),
        c as (select page_id as doc_id, unnest(range(0, page_id % 4 + 1)) as k from pages),
        b as (select doc_id, count(*) as n, count(*) filter ((doc_id + k) % 6 = 0 or (k + 1 <= 2 and (doc_id + k) % 7 = 0)) as bad from c group by doc_id),
        r as (select d.doc_id, cast(case when not web then 0 when stalled then case when sel > 0 then greatest(1, sel - n) else 1 end when sel > n then sel - n else bad end as bigint) as failed_count from d join b on d.doc_id = b.doc_id)
        select doc_id, failed_count > 0 as has_missing_or_failed, failed_count from r""",
    "digest_status": """select doc_id % 20 as doc_id, count(*) as total, count(*) filter (length(text) <= 2500 or (doc_id % 2 = 0 and doc_id % 6 <> 0)) as ready, count(*) filter (length(text) > 2500) as compressed from documents group by 1""",
    "digest_cache_miss": """select doc_id % 20 as doc_id, cast(doc_id as string) as chapter_id, sha256(text) as source_hash from documents where length(text) > 2500 and not (doc_id % 2 = 0 and doc_id % 6 <> 0)""",
    "weighted_progress": """with r as (select user_id, event_type, max(cast(floor(abs(value)) as bigint) % 101) as p from events group by 1, 2),
        k as (select u.user_id, t.k, case when u.user_id % 3 = 0 and t.k = 'view' then 0 else length(t.k) end as n from (select distinct user_id from events) u, (select unnest(['click', 'error', 'purchase', 'signup', 'view', 'other']) as k) t),
        j as (select k.user_id, n, coalesce(p, 0) as p from k left join r on r.user_id = k.user_id and r.event_type = k.k)
        select user_id as doc_id, cast(floor(case when min(n) > 0 then sum(p * n)::double / sum(n) else avg(p) end + 0.5) as int) as progress from j group by user_id""",
    "progress_running_max": """with v as (select *, cast(greatest(0, least(100, floor(abs(value) % 120 + 0.5))) as int) as r from events)
        select event_id, user_id, best, best >= 100 as completed from (select event_id, user_id, max(case when r >= 95 then 100 else r end) over (partition by user_id, event_type order by ts, event_id rows between unbounded preceding and current row) as best from v) t""",
}.items()}
