"""Queries on settings, notes, models, histories and scalar rules that the other plans leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import models as X
from lectern.functions import text as T
from lectern.operators import mutate as M
from lectern.operators import status as S
from lectern.sources import derive as D
from lectern.sources import documents

_C = F.col


def settings_overlay(spark, sf_dir):
    n = D.read(spark, sf_dir, "nation")
    base = F.create_map(F.lit("model"), F.lit("base"), F.lit("delay"), F.lit("1.0"), F.lit("lang"), F.lit("zh"))
    over = F.create_map(F.lit("model"), F.when(_C("n_nationkey") % 3 == 0, "").otherwise(_C("n_name")), F.lit("own"), F.lit("x"))
    m = M.overlay_settings(base, over)
    task = X.resolve_setting(F.when(_C("n_nationkey") % 4 == 0, " ").otherwise(F.lit("task")), F.when(_C("n_nationkey") % 8 == 0, F.lit(None).cast("string")).otherwise(_C("n_name")), F.lit("fallback"))
    return n.select("n_nationkey", m["model"].alias("model"), m["delay"].alias("delay"), m["own"].alias("own"), task.alias("resolved"))


def note_changes(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents")
    note = lambda i, c: F.struct(F.lit(i).alias("id"), c.alias("content"))
    notes = F.array(note("a", F.col("lang")), note("b", F.col("source")))
    more = M.add_note(notes, note("c", F.col("text")))
    out = M.delete_note(M.update_note(more, F.lit("b"), F.lit("new")), F.when(_C("doc_id") % 2 == 0, "a").otherwise("z"))
    return d.select("doc_id", F.array_join(F.transform(out, lambda x: F.concat(x["id"], F.lit("="), x["content"])), "|").alias("notes"))


def model_changes(spark, sf_dir):
    rows = D.read(spark, sf_dir, "nation").select(_C("n_name").alias("name"), F.lit("old").alias("config"), (_C("n_name") == "CHINA").alias("is_default"))
    new = D.read(spark, sf_dir, "region").select(_C("r_name").alias("name"), F.lit("new").alias("config"), F.lit(False).alias("is_default")).union(rows.where("name like 'A%'").withColumn("config", F.lit("new")))
    return M.delete_model(M.upsert_models(rows, new), "CHINA")


def refetch_targets(spark, sf_dir):
    p = D.read(spark, sf_dir, "pages").select((_C("page_id") % 10).alias("doc_id"), F.concat(F.lit("T"), (_C("page_id") % 7).cast("string")).alias("title"), F.when(_C("page_id") % 3 == 0, "").otherwise(_C("url")).alias("url"), (_C("page_id") % 4 != 0).alias("fetch_success"), _C("page_id"))
    selected = D.read(spark, sf_dir, "pages").select((_C("page_id") % 10).alias("doc_id"), F.concat(F.lit("T"), (_C("page_id") % 7).cast("string")).alias("title"), _C("url"), _C("page_id").alias("index"))
    return S.refetch_targets(p, selected).select("page_id", "doc_id", "title", "url")


def snapshot_latest(spark, sf_dir):
    p = D.paragraphs(spark, sf_dir)
    latest = p.where("ord % 2 = 0").select("doc_id", "id", "english", F.lit("later").alias("chinese"), F.lit("completed").alias("status"))
    return M.latest_paragraphs(p, latest).select("doc_id", "id", "chinese", "status")


def chapter_counts(spark, sf_dir):
    c = D.chapters(spark, sf_dir).withColumn("paragraph_count", F.lit(-1))
    return M.chapter_counts(c, D.paragraphs(spark, sf_dir).where("ch_ord % 2 = 0")).select("doc_id", "chapter_id", "paragraph_count")


def chat_append(spark, sf_dir):
    m = D.messages(spark, sf_dir).select("conv_id", "turn", "role")
    chat = F.explode(F.array("conv_id", -1 - _C("conv_id")))  # to each chat, and to one that isn't there yet
    new = m.select(chat.alias("conv_id"), "turn", F.concat(F.lit("new "), "role").alias("role"))
    return M.append_messages(m, new, "conv_id", "turn")


def scalar_rules(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("a.MD", "b.txt", "c.xlsx", "d.epub", "e.zip", "f.jpg", "g.tar", "h.pdf"))), (_C("doc_id") % 8 + 1).cast("int"))
    answer = F.concat(F.lit('<think>{"x": 0}</think> ok ```json\n{"n": '), _C("doc_id").cast("string"), F.lit("}\n``` end"))
    return d.select(
        "doc_id", documents.file_type(kind).alias("kind"), T.mime_of(kind).alias("mime"), F.get_json_object(T.cut_answer_json(answer), "$.n").alias("n"),
        T.cookies(F.concat(F.lit("a=1; lang="), "lang", F.lit("; bad; a=2=3")))["a"].alias("cookie"), T.asset_name(F.concat(F.lit("http://h/x/my pic."), "lang", F.lit("g?v=1"))).alias("asset"),
        documents.page_count(documents.file_type(kind), _C("n_chars"), F.lit(0), F.lit(7)).alias("pages"),
    )


def size_levels(spark, sf_dir):
    p = D.read(spark, sf_dir, "part")
    return p.select("p_partkey", T.size_heading_level(_C("p_size").cast("double"), F.lit(20.0), _C("p_partkey") % 2 == 0, F.concat("p_brand", F.when(_C("p_partkey") % 3 == 0, ".").otherwise("")), F.lit(False), F.lit(False), _C("p_partkey") % 5 == 0).alias("level"))


def table_overlap(spark, sf_dir):
    li = D.read(spark, sf_dir, "lineitem")
    a = {"x0": _C("l_quantity"), "y0": F.lit(0.0), "x1": _C("l_quantity") + 10, "y1": F.lit(10.0)}
    b = {"x0": F.lit(20.0), "y0": F.lit(5.0), "x1": F.lit(30.0), "y1": _C("l_linenumber") * 4.0}
    return li.select("l_orderkey", "l_linenumber", "l_quantity", F.sum(T.rect_overlap(a, b)).over(Window.partitionBy("l_orderkey", "l_linenumber", "l_quantity")).alias("shared"))


QUERIES = {f.__name__: f for f in (settings_overlay, note_changes, model_changes, refetch_targets, snapshot_latest, chapter_counts, chat_append, scalar_rules, size_levels, table_overlap)}

_MIME = "case doc_id % 8 when 5 then 'image/jpeg' else 'image/png' end"
ORACLES = {k: D.duck(v) for k, v in {
    "settings_overlay": """select n_nationkey, case when n_nationkey % 3 = 0 then 'base' else n_name end as model, '1.0' as delay, 'x' as own, case when n_nationkey % 4 <> 0 then 'task' when n_nationkey % 8 = 0 then 'fallback' else n_name end as resolved from nation""",
    "note_changes": "select doc_id, concat(case when doc_id % 2 = 0 then '' else concat('a=', lang, '|') end, 'b=new|c=', text) as notes from documents",
    "model_changes": """with n as (select n_name as name, case when n_name like 'A%' then 'new' else 'old' end as config from nation where n_name not in (select r_name from region) and n_name <> 'CHINA' union all select r_name, 'new' from region)
        select name, config, row_number() over (order by name) = 1 as is_default from n""",
    "refetch_targets": """with s as (select page_id % 10 as doc_id, concat('T', cast(page_id % 7 as string)) as title, arg_min(url, page_id) as u from pages group by 1, 2)
        select p.page_id, p.page_id % 10 as doc_id, s.title, case when p.page_id % 3 = 0 then s.u else p.url end as url from pages p join s on s.doc_id = p.page_id % 10 and s.title = concat('T', cast(p.page_id % 7 as string)) where p.page_id % 4 = 0""",
    "snapshot_latest": "select doc_id, id, case when ord % 2 = 0 then 'later' else chinese end as chinese, case when ord % 2 = 0 then 'completed' else status end as status from {paragraphs} p",
    "chapter_counts": "select doc_id, chapter_id, cast(case when ch_ord % 2 = 0 then paragraph_count else -1 end as int) as paragraph_count from {chapters} c",
    "chat_append": """with h as (select conv_id, turn, role from {messages} m), l as (select conv_id, max(turn) as last from h group by 1), m as (select * from h union all select -1 - conv_id, turn, role from h),
        n as (select m.conv_id, coalesce(last, -1) + row_number() over (partition by m.conv_id order by m.turn) as turn, concat('new ', role) as role from m left join l on l.conv_id = m.conv_id)
        select * from h union all select * from n""",
    "scalar_rules": f"""select doc_id, case doc_id % 8 when 0 then 'md' when 1 then 'txt' when 2 then 'excel' when 3 then 'epub' when 4 then 'folder' when 5 then 'image' when 6 then 'unsupported' else 'pdf' end as kind, {_MIME} as mime, cast(doc_id as string) as n, '2=3' as cookie,
        concat('my_pic_', left(md5(concat('http://h/x/my pic.', lang, 'g?v=1')), 8), '.', lang, 'g') as asset, cast(case doc_id % 8 when 0 then greatest(1, ceil(n_chars / 50)) when 1 then greatest(1, ceil(n_chars / 50)) when 5 then 1 else 7 end as int) as pages from documents""",
    "size_levels": """select p_partkey, cast(case when r >= 1.5::double then 1 when r >= 1.25::double then 2 when r >= 1.14::double then 3 when p_partkey % 2 = 0 and r >= 0.95::double and p_partkey % 3 <> 0 and p_partkey % 5 <> 0 then 3 else 0 end as int) as level from (select p_partkey, p_size / 20.0::double as r from part) t""",
    "table_overlap": """select l_orderkey, l_linenumber, l_quantity, sum(greatest(0, least(l_quantity + 10, 30) - greatest(l_quantity, 20)) * greatest(0, least(10, l_linenumber * 4) - 5)) over (partition by l_orderkey, l_linenumber, l_quantity)::double as shared from lineitem""",
}.items()}
