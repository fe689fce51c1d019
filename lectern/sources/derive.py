"""Study tables derived from the generic test tables, deterministically, in SQL that Spark and DuckDB both run.

documents.text has no headings, lists or CJK of its own; so lines are decorated by their ordinals. Each derivation is one SQL text with
table names in braces, used by the queries and, word for word, by the SQL that checks them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of documents: doc_id, ord (from 0), raw. The split differs between the engines, so each has its own.
LINES_DUCK = "(select doc_id, cast(i - 1 as int) as ord, l as raw from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(l) <> '')"

#: What DuckDB's trim takes off: spaces of any width, no tabs.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

PARAGRAPHS = """(
select p.doc_id, p.ord, cast(floor(p.ord / 5) as int) as ch_ord, concat('ch_', lpad(cast(cast(floor(p.ord / 5) as int) + 1 as string), 3, '0')) as chapter_id,
  concat('p_', cast(p.doc_id as string), '_', cast(p.ord as string)) as id,
  case when p.ord % 7 = 6 then 'image' when p.ord % 11 = 10 then 'code' else 'text' end as type,
  case when p.ord % 7 = 6 then concat('![fig](img/', cast(p.ord as string), '.png)') when p.ord % 13 = 12 then '' else p.raw end as english,
  case when l.quality = 1 or p.ord % 3 = 0 then case when p.ord % 9 = 0 then '[翻译调用异常: timeout]' else concat('译 ', substr(p.raw, 1, 20)) end else '' end as chinese,
  case when l.quality = 1 or p.ord % 3 = 0 then 'completed' else 'pending' end as status,
  coalesce(l.toxic = 1, false) as no_translate,
  case when p.ord % 14 = 6 then 'seen text' else '' end as extracted_text
from {lines} p left join {labels} l on p.doc_id = l.doc_id)"""

CHAPTERS = """(select doc_id, ch_ord, chapter_id, concat('Chapter ', cast(ch_ord + 1 as string)) as title, count(*) as paragraph_count from {paragraphs} p group by doc_id, ch_ord, chapter_id)"""

#: Lines as they might come from a Markdown or text file.
DECORATED = """(select doc_id, ord, case (ord + doc_id) % 12
  when 0 then concat('# ', raw) when 1 then concat('Chapter ', cast(ord + 1 as string), ' ', raw) when 2 then concat('- ', raw)
  when 3 then concat(cast(ord as string), '. ', raw) when 4 then concat('Figure ', cast(ord as string), ': ', raw) when 5 then concat('def ', raw)
  when 6 then concat('2.', cast(ord as string), ' ', raw) when 7 then concat('## ', raw) when 8 then concat('| ', raw, ' | b |') when 9 then concat('(a) ', raw)
  when 10 then concat('第', cast(ord as string), '章 ', raw) else raw end as line from {lines} p)"""

#: Latin vowels as CJK in a quarter of the documents.
MIXED = """(select doc_id, ord, case when doc_id % 4 = 0 then translate(raw, 'aeiou', '的一是不了') else raw end as line from {lines} p)"""

REVIEWS = """(select user_id, event_id, ts, case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 else 4 end as rating from {events} e)"""

MESSAGES = """(select conv_id, turn, role, text as content from {conversations} c)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "raw"))
    return docs.where(F.ltrim("raw", F.lit(SPACES)) != "")


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(f"select * from {sql} t", **tables)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, PARAGRAPHS, lines=lines(spark, sf_dir), labels=read(spark, sf_dir, "labels"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, CHAPTERS, paragraphs=paragraphs(spark, sf_dir))


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, DECORATED, lines=lines(spark, sf_dir))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, MIXED, lines=lines(spark, sf_dir))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, REVIEWS, events=read(spark, sf_dir, "events"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, MESSAGES, conversations=read(spark, sf_dir, "conversations"))


def duck(sql: str) -> str:
    """A derivation as DuckDB text, with nested ones filled in."""
    for _ in range(4):
        sql = sql.replace("{paragraphs}", PARAGRAPHS).replace("{lines}", LINES_DUCK).replace("{decorated}", DECORATED).replace("{mixed}", MIXED).replace("{chapters}", CHAPTERS)
        sql = sql.replace("{reviews}", REVIEWS).replace("{messages}", MESSAGES)
    for name in ("labels", "events", "conversations", "documents"):
        sql = sql.replace("{" + name + "}", name)
    return sql
