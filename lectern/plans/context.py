"""Queries on context windows, readable texts and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import clipped
from lectern.operators import context as X
from lectern.operators import mutate as M
from lectern.sources import derive as D

_C = F.col


def context_frame_pos(spark, sf_dir):
    rows = X.frame_by_position(D.messages(spark, sf_dir), ["conv_id"], ["turn"], "turn", 2, 1)
    return rows.select("conv_id", "turn", F.array_join(_C("frame").cast("array<string>"), ",").alias("frame"))


def context_frame_nonblank(spark, sf_dir):
    m = D.messages(spark, sf_dir).withColumn("v", F.when(_C("turn") % 3 == 1, "  ").otherwise(F.concat(F.lit("t"), _C("turn").cast("string"))))
    return X.frame_nonblank(m, ["conv_id"], "turn", "v", 2, 2).select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def last_readable(spark, sf_dir):
    return X.last_readable(D.paragraphs(spark, sf_dir), ["doc_id"], "ord", "english", ["chinese"]).select("doc_id", "ord", _C("previous.english").alias("english"), _C("previous.chinese").alias("chinese"))


def chat_tail_30(spark, sf_dir):
    return X.chat_tail(D.messages(spark, sf_dir), "conv_id", "turn", 3).select("conv_id", "turn", "role")


def chat_pair_delete(spark, sf_dir):
    m = D.messages(spark, sf_dir)
    return X.delete_with_partner(m, m.where("(conv_id + turn) % 5 = 0"), "conv_id", "turn").select("conv_id", "turn", "role")


def chapter_readable_text(spark, sf_dir):
    return X.chapter_text(D.paragraphs(spark, sf_dir), ["doc_id", "chapter_id"], "ord").select("doc_id", "chapter_id", "body", "char_count")


def document_context_budget(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents").select(_C("source").alias("doc_id"), _C("doc_id").alias("n"), F.concat(F.lit("T"), _C("doc_id").cast("string")).alias("title"), "text")
    return X.document_context(d, "n", "title", "text", 24_000)


def digest_fallback(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents")
    return d.select("doc_id", X.rule_digest(_C("source"), _C("text")).alias("digest"))


def chapter_chat_body(spark, sf_dir):
    body = X.chapter_text(D.paragraphs(spark, sf_dir), ["doc_id", "chapter_id"], "ord")
    return body.select("doc_id", "chapter_id", F.sha2(clipped(_C("body"), X.CHAPTER_CHARS, X.CUT_MARK), 256).alias("body_sha256"), F.length("body").alias("n"))


def latest_log(spark, sf_dir):
    return M.latest_log(D.read(spark, sf_dir, "events"), "event_type", "event_id", 20).select("event_type", "event_id", "pos")


QUERIES = {f.__name__: f for f in (
    context_frame_pos, context_frame_nonblank, last_readable, chat_tail_30, chat_pair_delete, chapter_readable_text, document_context_budget, digest_fallback, chapter_chat_body, latest_log,
)}

_N = "cast(row_number() over (partition by doc_id, chapter_id order by ord) as string)"
_UNITS = f"""(select doc_id, chapter_id, ord, case when img and c <> '' then concat('[第 ', n, ' 单元: 图文内容]:', chr(10), c) when img then concat('[第 ', n, ' 单元: 幻灯片图片]') when t <> '' then concat('[第 ', n, ' 段]: ', s, chr(10), '[译文/精读]: ', t) else concat('[第 ', n, ' 段]: ', s) end as unit
  from (select *, {_N} as n, case when x <> '' then x when t <> '' and not starts_with(t, '[OCR') then t else '' end as c from (select *, trim(english) as s, trim(chinese) as t, trim(extracted_text) as x, type in ('scanned_page', 'image') or contains(english, '![') as img from {{paragraphs}} p) a where img or s <> '') b)"""

ORACLES = {k: D.duck(v) for k, v in {
    "context_frame_pos": "select conv_id, turn, array_to_string(list(turn) over (partition by conv_id order by turn rows between 2 preceding and 1 following), ',') as frame from {messages} m",
    "context_frame_nonblank": """with v as (select conv_id, turn, case when turn % 3 = 1 then null else concat('t', cast(turn as string)) end as v from {messages} m),
        b as (select v.conv_id, v.turn, o.v as ov, o.turn as ot, row_number() over (partition by v.conv_id, v.turn order by o.turn desc) as k from v join v o on v.conv_id = o.conv_id and o.turn < v.turn and o.v is not null),
        a as (select v.conv_id, v.turn, o.v as ov, o.turn as ot, row_number() over (partition by v.conv_id, v.turn order by o.turn) as k from v join v o on v.conv_id = o.conv_id and o.turn > v.turn and o.v is not null)
        select v.conv_id, v.turn, coalesce((select string_agg(ov, ',' order by ot) from b where b.conv_id = v.conv_id and b.turn = v.turn and k <= 2), '') as before,
          coalesce((select string_agg(ov, ',' order by ot) from a where a.conv_id = v.conv_id and a.turn = v.turn and k <= 2), '') as after from v""",
    "last_readable": """with r as (select doc_id, ord, english, chinese, case when type in ('text', 'scanned_page') and trim(english) <> '' then ord end as ok from {paragraphs} p),
        m as (select doc_id, ord, max(ok) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as p from r)
        select m.doc_id, m.ord, r.english, r.chinese from m left join r on m.doc_id = r.doc_id and m.p = r.ord""",
    "chat_tail_30": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from {messages} m) t where n <= 3 and role in ('user', 'assistant') and trim(content) <> ''",
    "chat_pair_delete": """with m as (select conv_id, turn, role, (conv_id + turn) % 5 = 0 as gone, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as p,
          min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following) as n from {messages} c),
        t as (select conv_id, p as turn from m where gone and role = 'assistant' and p is not null union select conv_id, n from m where gone and role = 'user' and n is not null)
        select m.conv_id, m.turn, m.role from m left join t on m.conv_id = t.conv_id and m.turn = t.turn where not gone and t.turn is null""",
    "chapter_readable_text": f"select doc_id, chapter_id, body, cast(length(body) as int) as char_count from (select doc_id, chapter_id, string_agg(unit, concat(chr(10), chr(10)) order by ord) as body from {_UNITS} u group by 1, 2) t",
    "document_context_budget": """select doc_id, chapters, original_chars, case when length(a) > 24000 then concat(left(a, 24000), chr(10), chr(10), '[...]') else a end as context from (select source as doc_id, count(*) as chapters, cast(sum(length(text)) as bigint) as original_chars,
        string_agg(concat('## T', cast(doc_id as string), chr(10), text), concat(chr(10), chr(10)) order by doc_id) as a from documents group by 1) t""",
    "digest_fallback": """select doc_id, concat('### 《', source, '》要点摘要 (快速提取)', chr(10), chr(10), coalesce((select string_agg(concat('- ', left(s, 120)), chr(10) order by k) from (select s, row_number() over (order by i) as k from (select trim(unnest(string_split(text, chr(10)))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i) x where starts_with(s, '#') or starts_with(s, '[第') or length(s) > 40) y where k <= 8), '')) as digest from documents""",
    "chapter_chat_body": f"select doc_id, chapter_id, sha256(case when length(body) > 16000 then concat(left(body, 16000), chr(10), chr(10), '[...]') else body end) as body_sha256, cast(length(body) as int) as n from (select doc_id, chapter_id, string_agg(unit, concat(chr(10), chr(10)) order by ord) as body from {_UNITS} u group by 1, 2) t",
    "latest_log": "select event_type, event_id, cast(pos as int) as pos from (select event_type, event_id, row_number() over (partition by event_type order by event_id desc) as pos from events) t where pos <= 20",
}.items()}
