"""Queries on chapters, layout and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import mutate as M
from lectern.operators import structure as S
from lectern.sinks.versions import settled
from lectern.sources import derive as D
from lectern.sources import documents

_C = F.col


def paragraph_explode(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n \n").alias("text"))
    rows = d.select("doc_id", F.posexplode(T.blank_line_paragraphs(_C("text"))).alias("ord", "para"))
    return S.paragraph_ids(rows.withColumn("chapter_no", F.lit(1)), ["doc_id"], ["ord"]).select("doc_id", "ord", "id", "para")


def chapter_islands(spark, sf_dir):
    rows = S.chapter_ids(D.decorated(spark, sf_dir), ["doc_id"], ["ord"], T.heading_level(_C("line")) > 0)
    return S.paragraph_ids(rows, ["doc_id"], ["ord"]).select("doc_id", "ord", "chapter_id", "id")


def txt_batches_45(spark, sf_dir):
    return S.batch_chapters(D.lines(spark, sf_dir), ["doc_id"], ["ord"]).select("doc_id", "ord", "chapter_no")


def heading_census(spark, sf_dir):
    return S.heading_census(D.decorated(spark, sf_dir), ["doc_id"], "line", F.lit(False))


def stitch_continuation(spark, sf_dir):
    blocks = D.lines(spark, sf_dir).select("doc_id", F.floor(_C("ord") / 3).cast("int").alias("page"), "ord", F.when(_C("ord") % 4 == 2, F.regexp_replace("raw", r"\.$", "")).otherwise(_C("raw")).alias("t"), F.lit("text").alias("type"), F.lit(False).alias("is_heading"), F.lit(False).alias("is_list"), F.lit("").alias("list_type"))
    return S.stitch_pages(blocks, ["doc_id"], "page", "ord", "t").select("doc_id", "first_order", "n_blocks", "content")


def list_groups(spark, sf_dir):
    rows = D.decorated(spark, sf_dir).withColumn("list_type", F.when(T.is_list_item(_C("line")), T.list_type(_C("line"))).otherwise(""))
    return S.list_groups(rows, ["doc_id"], ["ord"]).select("doc_id", "ord", "list_group")


def _layout(spark, sf_dir):
    li = D.read(spark, sf_dir, "lineitem")
    y = _C("l_linenumber") * 20 + _C("l_quantity") % 13
    return li.select("l_orderkey", "l_linenumber", _C("l_extendedprice").alias("price"), y.alias("y0"), (y + 10).alias("y1"))


def line_gap_groups(spark, sf_dir):
    return S.line_gap_groups(_layout(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "price"], F.lit(7.0)).select("l_orderkey", "l_linenumber", "price", "para")


def line_pitch(spark, sf_dir):
    return S.line_pitch(_layout(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "price"], F.lit(12.0))


def body_font_size(spark, sf_dir):
    li = D.read(spark, sf_dir, "lineitem")
    spans = li.select("l_orderkey", _C("l_linenumber").alias("page"), (_C("l_tax") * 100 + 8).alias("size"), F.when(_C("l_returnflag") == "R", 16).otherwise(0).alias("flags"), F.expr("repeat('x', cast(l_quantity as int))").alias("text"), _C("l_partkey").alias("ord"))
    return S.body_font_size(spans, "l_orderkey")


def _margins(spark, sf_dir):
    band = F.when(_C("ord") % 5 == 0, "top").when(_C("ord") % 5 == 4, "bottom")
    text = F.when((_C("ord") % 5 == 0) & (_C("doc_id") % 2 == 0), "Running title").when(_C("ord") % 10 == 4, F.concat(F.lit("Page "), _C("ord").cast("string"))).otherwise(_C("raw"))
    return D.lines(spark, sf_dir).select("doc_id", F.floor(_C("ord") / 5).cast("int").alias("page"), "ord", band.alias("band"), text.alias("t"))


def running_headers(spark, sf_dir):
    return S.running_lines(_margins(spark, sf_dir), "doc_id", "page", "band", "t")


def without_margins(spark, sf_dir):
    return S.without_running_lines(_margins(spark, sf_dir), "doc_id", "page", "band", "t").select("doc_id", "ord")


def outside_tables(spark, sf_dir):
    li = D.read(spark, sf_dir, "lineitem")
    b = li.select("l_orderkey", "l_linenumber", "l_partkey", (_C("l_quantity") * 1.0).alias("x0"), (_C("l_linenumber") * 10.0).alias("y0"), (_C("l_quantity") + 20.0).alias("x1"), (_C("l_linenumber") * 10.0 + 8).alias("y1"))
    t = D.read(spark, sf_dir, "orders").select(_C("o_orderkey").alias("l_orderkey"), F.lit(10.0).alias("x0"), F.lit(15.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(45.0).alias("y1"))
    return S.outside_tables(b, t, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


def toc_page_ranges(spark, sf_dir):
    p = D.lines(spark, sf_dir)
    pages = p.groupBy("doc_id").agg((F.max("ord") + 1).alias("pages"))
    toc = p.where("ord % 4 = 0").join(pages, "doc_id").select("doc_id", "ord", "pages", (_C("ord") + 1).alias("start"))
    ranges = S.toc_ranges(toc, "doc_id", "start", "pages")
    each = p.select("doc_id", (_C("ord") + 1).alias("page"))
    return S.assign_pages(each, ranges.select("doc_id", "start", "end_page"), "doc_id", "page", "start").select("doc_id", "page", "start", "end_page")


def scanned_documents(spark, sf_dir):
    rows = D.lines(spark, sf_dir).select("doc_id", (_C("ord") + 1).alias("page"), F.when(_C("doc_id") % 3 == 0, F.left("raw", F.lit(25))).otherwise(_C("raw")).alias("t"))
    return S.scanned(rows, "doc_id", "page", "t")


def page_buckets(spark, sf_dir):
    return S.paged(D.lines(spark, sf_dir), ["doc_id"], ["ord"], 22).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def merge_short_blocks(spark, sf_dir):
    rows = D.lines(spark, sf_dir).select("doc_id", "ord", F.floor(_C("ord") / 6).cast("int").alias("page"), _C("raw").alias("t"))
    return S.merge_short_blocks(rows, "doc_id", "ord", "page", "t")


def _laid_out(spark, sf_dir):
    """Lines with places, sizes and weights, as a layout reader gives them: some stand in the margins, some are bold or large."""
    top = _C("ord") % 9
    band = F.when((top == 0) & (_C("ord") % 2 == 0), "top").when(top == 8, "bottom")
    y0 = (top * 20 + (_C("ord") + _C("doc_id")) % 4 * 7).cast("double")
    text = F.when(band == "top", "Running title").when(band == "bottom", F.concat(F.lit("- "), _C("ord").cast("string"), F.lit(" -"))).otherwise(_C("line"))
    return D.decorated(spark, sf_dir).select(
        "doc_id", F.floor(_C("ord") / 9).cast("int").alias("page"), "ord", text.alias("text"), y0.alias("y0"), (y0 + 12).alias("y1"), band.alias("band"),
        F.when((_C("ord") + _C("doc_id")) % 12 == 0, 16.0).otherwise(11.0).alias("size"), F.lit(11.0).alias("body_size"), (_C("ord") % 13 == 5).alias("bold"),
    )


def layout_paragraphs(spark, sf_dir):
    return S.layout_blocks(_laid_out(spark, sf_dir)).select("doc_id", "page", "n", "text")


def table_boxes(spark, sf_dir):
    x0 = (_C("l_quantity") % 7) * 5.0
    li = D.read(spark, sf_dir, "lineitem").select("l_orderkey", x0.alias("x0"), (_C("l_linenumber") * 60.0).alias("y0"), (x0 + _C("l_quantity")).alias("x1"), (_C("l_linenumber") * 60.0 + _C("l_partkey") % 70).alias("y1"))
    return S.merged_tables(li, ["l_orderkey"])


def _outline(spark, sf_dir):
    rows = D.decorated(spark, sf_dir)
    blocks = settled(rows.select("doc_id", _C("ord"), F.floor(_C("ord") / 4).cast("int").alias("page"), _C("line").alias("content"), (T.heading_level(_C("line")) > 0).alias("is_heading")), "outline")
    targets = blocks.where("is_heading").select("doc_id", _C("ord").alias("n"), F.regexp_replace("content", "^#+ ", "").alias("title"), _C("page").alias("start_page"), F.when(_C("ord") % 10 == 9, _C("ord")).alias("block_idx"))
    return blocks, targets


def partition_chapters(spark, sf_dir):
    blocks, targets = _outline(spark, sf_dir)
    return S.partition_chapters(blocks, targets, "doc_id").select("doc_id", "ord", "chapter_no", "title")


def shift_chapter(spark, sf_dir):
    p, c = D.paragraphs(spark, sf_dir), D.chapters(spark, sf_dir)
    p = p.withColumn("gord", _C("ord")).withColumn("ord", _C("ord") % 5)
    req = D.read(spark, sf_dir, "documents").select("doc_id", F.lit("ch_002").alias("chapter_id"), (_C("doc_id") % 5).cast("int").alias("at"), F.when(_C("doc_id") % 2 == 0, "prev").otherwise("next").alias("direction"), F.when(_C("doc_id") % 3 == 0, "single").otherwise("slice").alias("scope"))
    return M.shift_paragraphs(_dense(p), c, req)[0].select("doc_id", "chapter_id", "ord", "id")


def _dense(p):
    return M.renumber(p, [_C("ord")])


def split_chapter(spark, sf_dir):
    p, c = _dense(D.paragraphs(spark, sf_dir)), D.chapters(spark, sf_dir)
    req = D.read(spark, sf_dir, "documents").select("doc_id", F.lit("ch_001").alias("chapter_id"), (_C("doc_id") % 4).cast("int").alias("at"), F.lit("Second half").alias("title"))
    return M.split_chapter(p, c, req)[1].select("doc_id", "ch_ord", "title")


def merge_paragraphs(spark, sf_dir):
    p = _dense(D.paragraphs(spark, sf_dir))
    req = D.read(spark, sf_dir, "documents").select("doc_id", F.lit("ch_001").alias("chapter_id"), (_C("doc_id") % 4).cast("int").alias("at"))
    return M.merge_paragraphs(p, req).where("chapter_id = 'ch_001'").select("doc_id", "ord", "id", "english", "chinese")


def insert_paragraph(spark, sf_dir):
    p = _dense(D.paragraphs(spark, sf_dir))
    new = D.read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("ch_001").alias("chapter_id"), (_C("doc_id") % 3).cast("int").alias("after"), F.lit("p_new").alias("id"), F.lit("new").alias("english"))
    return M.insert_after(p, new).select("doc_id", "chapter_id", "ord", "id")


def delete_paragraph_cascade(spark, sf_dir):
    p = _dense(D.paragraphs(spark, sf_dir))
    doomed = p.where("ord = 1").select("doc_id", "id")
    cards = p.select("doc_id", _C("id").alias("paragraph_id"), "chapter_id")
    left, c, m = M.delete_paragraphs(p, cards, cards, doomed)
    return left.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max("ord").alias("last")).join(c.groupBy("doc_id").agg(F.count("*").alias("cards")), "doc_id").join(m.groupBy("doc_id").agg(F.count("*").alias("messages")), "doc_id")


def delete_chapter_cascade(spark, sf_dir):
    p, c = D.paragraphs(spark, sf_dir), D.chapters(spark, sf_dir)
    docs = D.read(spark, sf_dir, "documents").select("doc_id")
    hang = p.select("doc_id", "chapter_id", "id")
    d, left, paras, _, _ = M.delete_chapters(docs, c, p, hang, hang, c.where("ch_ord = 0").select("doc_id", "chapter_id"))
    counts = left.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.max("ch_ord").alias("last")).join(paras.groupBy("doc_id").agg(F.count("*").alias("paragraphs")), "doc_id")
    return d.join(counts, "doc_id")


def edit_paragraphs(spark, sf_dir):
    p = D.paragraphs(spark, sf_dir).withColumn("image_url", F.lit(""))
    n = _C("ord")
    edits = p.where("ord % 2 = 0").select("doc_id", "id", F.when(n % 6 == 0, " ![x](a/b.png) ").when(n % 6 == 2, "```\ncode\n```").otherwise("plain text here").alias("text"))
    return M.edit_paragraphs(p, edits).select("doc_id", "id", "type", "status", "no_translate", "image_url")


def rename_chapters(spark, sf_dir):
    names = D.chapters(spark, sf_dir).select("doc_id", "chapter_id", F.when(_C("ch_ord") % 2 == 0, "  New ").otherwise(" ").alias("new_title"))
    return M.rename_chapters(D.chapters(spark, sf_dir), names).select("doc_id", "ch_ord", "title")


def markdown_chapters(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n\n")
    docs = D.decorated(spark, sf_dir).groupBy("doc_id").agg(text.alias("text"))
    return documents.parse_markdown(docs).groupBy("doc_id", "chapter_id", "title").agg(F.count("*").alias("paragraphs"), F.count_if(_C("type") == "table").alias("tables"))


def text_chapters(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n\n")
    docs = D.decorated(spark, sf_dir).groupBy("doc_id").agg(text.alias("text"))
    return documents.parse_text(docs).groupBy("doc_id", "chapter_id", "title").agg(F.count("*").alias("paragraphs"))


QUERIES = {f.__name__: f for f in (
    paragraph_explode, chapter_islands, txt_batches_45, heading_census, stitch_continuation, list_groups, line_gap_groups, line_pitch, body_font_size, running_headers, without_margins, outside_tables,
    toc_page_ranges, scanned_documents, page_buckets, merge_short_blocks, layout_paragraphs, table_boxes, partition_chapters, shift_chapter, split_chapter, merge_paragraphs, insert_paragraph, delete_paragraph_cascade, delete_chapter_cascade,
    edit_paragraphs, rename_chapters, markdown_chapters, text_chapters,
)}

_LAYOUT = "(select *, y0 - lag(y1) over w as gap, y0 - lag(y0) over w as dy from (select l_orderkey, l_linenumber, l_extendedprice as price, l_linenumber * 20 + l_quantity % 13 as y0, l_linenumber * 20 + l_quantity % 13 + 10 as y1 from lineitem) a window w as (partition by l_orderkey order by l_linenumber, price))"
_MARGINS = "(select doc_id, cast(floor(ord / 5) as int) as page, ord, case ord % 5 when 0 then 'top' when 4 then 'bottom' end as band, case when ord % 5 = 0 and doc_id % 2 = 0 then 'Running title' when ord % 10 = 4 then concat('Page ', cast(ord as string)) else raw end as t from {lines} l)"
_RUNNING = f"(select doc_id, band, t from {_MARGINS} m where page <= 80 and length(t) <= 120 and band is not null group by all having count(*) >= 2)"
_DENSE = "(select * exclude (ord), ord as gord, cast(row_number() over (partition by doc_id, chapter_id order by ord) - 1 as int) as ord from {paragraphs} p)"
_TERMINAL = "case when regexp_matches(lower(x), '(^|[^\\p{L}\\p{N}_])(e\\.g|i\\.e|etc|vs|al|fig|ref|approx|dept|no|vol|sec|ch|dr|mr|mrs|ms|prof|inc|ltd|co|corp)\\.$') then false when regexp_matches(x, '([:：—–]|--)$') then true else regexp_matches(x, '[.!?。！？][\"''\\)\\]}”’]*$') end"
_TERM = "(rtrim(s, '\"''”’»›」』)）]】}｝〉》>') <> '' and contains('.。!！?？…｡﹗﹖', right(rtrim(s, '\"''”’»›」』)）]】}｝〉》>'), 1)))"
_JOIN = f"case when s = '' then t when t = '' then s when {_TERM} then concat(s, chr(10), t) when not regexp_matches(s, '[\\p{{P}}\\p{{S}}]$') then concat(s, ' ', t) else concat(s, t) end"
_KIND = "case when not (line like '#%') then case when regexp_matches(line, '^- ') then 'bullet' when regexp_matches(line, '^\\d\\d?\\. ') then 'decimal' when regexp_matches(line, '^2\\.\\d+ ') then 'decimal' when regexp_matches(line, '^\\(a\\) ') then 'alpha_paren' when regexp_matches(line, '^第') then 'other' else '' end else '' end"

_JOINS = "((c > 0 and least(ay1, y1) > greatest(ay0, y0)) or (greatest(ax1, x1) - least(ax0, x0) > 0 and c > 0.65::double * (greatest(ax1, x1) - least(ax0, x0)) and y0 - ay1 < 80))"

ORACLES = {k: D.duck(v) for k, v in {
    "table_boxes": f"""with recursive b as (select *, row_number() over (partition by l_orderkey order by y0, x0, x1, y1) as i from (select l_orderkey, (l_quantity % 7) * 5.0::double as x0, l_linenumber * 60.0::double as y0, (l_quantity % 7) * 5.0::double + l_quantity as x1, l_linenumber * 60.0::double + l_partkey % 70 as y1 from lineitem) t),
        r as (select l_orderkey, i, 0 as n, x0 as ax0, y0 as ay0, x1 as ax1, y1 as ay1 from b where i = 1
          union all select l_orderkey, i, case when {_JOINS} then n else n + 1 end, case when {_JOINS} then least(ax0, x0) else x0 end, case when {_JOINS} then least(ay0, y0) else y0 end, case when {_JOINS} then greatest(ax1, x1) else x1 end, case when {_JOINS} then greatest(ay1, y1) else y1 end
          from (select b.*, n, ax0, ay0, ax1, ay1, least(ax1, x1) - greatest(ax0, x0) as c from r join b on b.l_orderkey = r.l_orderkey and b.i = r.i + 1) s)
        select l_orderkey, n, ax0 as x0, ay0 as y0, ax1 as x1, ay1 as y1 from (select *, row_number() over (partition by l_orderkey, n order by i desc) as k from r) z where k = 1""",
    "paragraph_explode": """with p as (select doc_id, trim(p, concat(' ', chr(10), chr(9), chr(13))) as para, i from (select doc_id, unnest(x) as p, generate_subscripts(x, 1) as i from (select doc_id, regexp_split_to_array(regexp_replace(text, '\\. ', concat('.', chr(10), ' ', chr(10)), 'g'), '\\n\\s*\\n+') as x from documents) a) b)
        select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as ord, printf('p_001_%04d', row_number() over (partition by doc_id order by i)) as id, para from p where para <> ''""",
    "chapter_islands": """with h as (select doc_id, ord, sum(case when regexp_matches(line, '^#{1,6}\\s') then 1 else 0 end) over (partition by doc_id order by ord) as k, row_number() over (partition by doc_id order by ord) as n from {decorated} d),
        c as (select *, k - min(k) over (partition by doc_id) + 1 as c from h)
        select doc_id, ord, printf('ch_%03d', cast(c as int)) as chapter_id, printf('p_%03d_%04d', cast(c as int), n) as id from c""",
    "txt_batches_45": "select doc_id, ord, cast(case when n > 50 then floor((k - 1) / 45) + 1 else 1 end as int) as chapter_no from (select doc_id, ord, row_number() over (partition by doc_id order by ord) as k, count(*) over (partition by doc_id) as n from {lines} l) t",
    "heading_census": """select *, case when h1 >= 2 then '#' when h1 = 1 and h2 >= 1 then '#{1,2}' when h1 = 1 then '#' when h2 >= 1 then '##' when h3 >= 2 then '###' else '' end as rule from
        (select doc_id, count(*) filter (regexp_matches(line, '^#\\s+[^#]')) as h1, count(*) filter (regexp_matches(line, '^##\\s+[^#]')) as h2, count(*) filter (regexp_matches(line, '^###\\s+[^#]')) as h3 from {decorated} d group by doc_id) t""",
    "stitch_continuation": f"""with b as (select doc_id, cast(floor(ord / 3) as int) as page, ord, case when ord % 4 = 2 then regexp_replace(raw, '\\.$', '') else raw end as t from {{lines}} l),
        c as (select *, regexp_replace(trim(t), '[*_`\\s]+$', '') as x from b), d as (select *, {_TERMINAL} as term from c),
        e as (select *, case when lag(page) over w is not null and page <> lag(page) over w and not lag(term) over w then 1 else 0 end as joins, regexp_matches(lag(x) over w, '[\\p{{L}}\\p{{N}}_]-$') as hyph from d window w as (partition by doc_id order by page, ord)),
        f as (select *, sum(1 - joins) over (partition by doc_id order by page, ord) as g, lead(joins) over w = 1 as more, lead(hyph) over w as cut from e window w as (partition by doc_id order by page, ord))
        select doc_id, min(ord) as first_order, cast(count(*) as int) as n_blocks, case when count(*) = 1 then max(t) else string_agg(case when more and cut then left(trim(t), length(trim(t)) - 1) when more then concat(trim(t), ' ') else trim(t) end, '' order by ord) end as content from f group by doc_id, g""",
    "list_groups": f"""with k as (select doc_id, ord, {_KIND} as f from {{decorated}} d), s as (select *, case when f <> '' and lag(f) over (partition by doc_id order by ord) = f then 0 else 1 end as st from k)
        select doc_id, ord, cast(sum(st) over (partition by doc_id order by ord) as bigint) as list_group from s""",
    "line_gap_groups": f"select l_orderkey, l_linenumber, price, cast(sum(case when gap is null or gap > 1.4::double * 7 then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, price) as bigint) as para from {_LAYOUT} t",
    "line_pitch": f"select l_orderkey, coalesce(median(case when dy > 8 and dy < 80 then dy end), 1.35::double * 12) as pitch from {_LAYOUT} t group by l_orderkey",
    "body_font_size": """select l_orderkey, arg_max(size, (n, -f)) as body_size from (select l_orderkey, round(l_tax * 100 + 8, 1) as size, sum(cast(l_quantity as int)) as n, min(l_partkey) as f from lineitem where l_returnflag <> 'R' and l_linenumber <= 25 and cast(l_quantity as int) > 0 group by 1, 2) t group by 1""",
    "running_headers": f"select * from {_RUNNING} t",
    "without_margins": f"select m.doc_id, m.ord from {_MARGINS} m left join {_RUNNING} r on m.doc_id = r.doc_id and m.band = r.band and m.t = r.t where r.t is null and (m.band is null or not regexp_matches(m.t, '(?i)^\\s*([-–—.]*\\s*\\d+\\s*[-–—.]*|page\\s+\\d+(\\s+of\\s+\\d+)?|\\d+\\s*/\\s*\\d+|第\\s*\\d+\\s*页|[ivxlc]+)\\s*$'))",
    "outside_tables": """select l_orderkey, l_linenumber, l_partkey from lineitem where not (l_orderkey in (select o_orderkey from orders) and
        greatest(0, least(l_quantity + 20, 40) - greatest(l_quantity, 10)) * greatest(0, least(l_linenumber * 10 + 8, 45) - greatest(l_linenumber * 10, 15)) > 0.6::double * 20 * 8)""",
    "toc_page_ranges": """with p as (select doc_id, max(ord) + 1 as pages from {lines} l group by 1), t as (select l.doc_id, ord + 1 as start, greatest(ord + 1, coalesce(lead(ord + 1) over (partition by l.doc_id order by ord) - 1, pages)) as end_page from {lines} l join p on l.doc_id = p.doc_id where ord % 4 = 0)
        select l.doc_id, l.ord + 1 as page, t.start, t.end_page from {lines} l join t on l.doc_id = t.doc_id and l.ord + 1 between t.start and t.end_page""",
    "scanned_documents": "select doc_id, avg(length(trim(case when doc_id % 3 = 0 then left(raw, 25) else raw end))) < 30 as is_scanned from {lines} l where ord + 1 <= 10 group by doc_id",
    "page_buckets": "select doc_id, cast(floor((n - 1) / 22) + 1 as int) as page, count(*) as n from (select doc_id, row_number() over (partition by doc_id order by ord) as n from {lines} l) t group by 1, 2",
    "shift_chapter": f"""with s as (select p.*, mx.last, case when p.chapter_id = 'ch_002' and (p.doc_id % 2 = 0 or mx.last >= 2) then case when p.doc_id % 3 = 0 then p.ord = p.doc_id % 5 when p.doc_id % 2 = 0 then p.ord <= p.doc_id % 5 else p.ord >= p.doc_id % 5 end else false end as moves
          from {_DENSE} p join (select doc_id, max(ch_ord) as last from {{paragraphs}} q group by 1) mx on p.doc_id = mx.doc_id),
        u as (select *, case when moves then case when doc_id % 2 = 0 then 'ch_001' else 'ch_003' end else chapter_id end as c, case when not moves then 0 when doc_id % 2 = 0 then 1 else -1 end as side from s)
        select doc_id, c as chapter_id, cast(row_number() over (partition by doc_id, c order by side, ord) - 1 as int) as ord, id from u""",
    "split_chapter": f"""with z as (select doc_id, max(ord) as last from {_DENSE} p where chapter_id = 'ch_001' group by 1), c as (select doc_id, ch_ord, title, 0 as half from {{chapters}} c union all select doc_id, 0, 'Second half', 1 from z where doc_id % 4 > 0 and doc_id % 4 <= last)
        select doc_id, cast(row_number() over (partition by doc_id order by ch_ord, half) - 1 as int) as ch_ord, title from c""",
    "merge_paragraphs": f"""with d as (select *, lead(english) over w as nx, lead(ord) over w is not null as has from {_DENSE} p where chapter_id = 'ch_001' window w as (partition by doc_id order by ord)),
        e as (select *, ord = doc_id % 4 and has as f, ord = doc_id % 4 + 1 as gone, regexp_replace(english, '\\s+$', '') as s, regexp_replace(coalesce(nx, ''), '^\\s+', '') as t from d)
        select doc_id, cast(row_number() over (partition by doc_id order by ord) - 1 as int) as ord, id, case when f then {_JOIN} else english end as english, case when f then '' else chinese end as chinese from e where not gone""",
    "insert_paragraph": f"""with a as (select doc_id, chapter_id, ord, 0 as half, id from {_DENSE} p union all select doc_id, 'ch_001', cast(doc_id % 3 as int), 1, 'p_new' from documents where doc_id % 2 = 0)
        select doc_id, chapter_id, cast(row_number() over (partition by doc_id, chapter_id order by ord, half, id) - 1 as int) as ord, id from a""",
    "delete_paragraph_cascade": f"""with k as (select doc_id, chapter_id, count(*) filter (ord <> 1) as n from {_DENSE} p group by 1, 2)
        select doc_id, cast(sum(n) as bigint) as paragraphs, cast(max(n) - 1 as int) as last, cast(sum(n) as bigint) as cards, cast(sum(n) as bigint) as messages from k where n > 0 group by doc_id""",
    "delete_chapter_cascade": """select doc_id, count(distinct ch_ord) as chapters, cast(count(distinct ch_ord) - 1 as int) as last, count(*) as paragraphs from {paragraphs} p where ch_ord > 0 group by doc_id""",
    "edit_paragraphs": """select doc_id, id, case when ord % 2 = 1 then type when ord % 6 = 0 then 'image' when ord % 6 = 2 then 'code' when type in ('image', 'code') then 'text' else type end as type,
        case when ord % 2 = 1 then status when ord % 6 = 4 then 'pending' else 'completed' end as status, case when ord % 2 = 1 then no_translate else ord % 6 <> 4 end as no_translate, case when ord % 6 = 0 then 'a/b.png' else '' end as image_url from {paragraphs} p""",
    "rename_chapters": "select doc_id, ch_ord, case when ch_ord % 2 = 0 then 'New' else title end as title from {chapters} c",
}.items()}
