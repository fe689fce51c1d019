"""Queries on the web, assets, exports, settings lists and model answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import answers
from lectern.operators import assets as A
from lectern.sinks import export as E
from lectern.sources import derive as D
from lectern.sources import web as W

_C = F.col


def web_titles(spark, sf_dir):
    p = D.read(spark, sf_dir, "pages")
    return p.select("page_id", W.page_title(_C("html")).alias("page_title"), W.site_title(_C("html")).alias("site_title"))


def web_sidebar_links(spark, sf_dir):
    return W.sidebar(D.read(spark, sf_dir, "pages")).select("page_id", "ord", "title", "url", "is_current")


def web_url_canonical(spark, sf_dir):
    p = D.read(spark, sf_dir, "pages")
    url = F.concat("url", F.element_at(F.array(*map(F.lit, ("", "/", "?a=1", "#x", ";p?q#r"))), (_C("page_id") % 5 + 1).cast("int")))
    return p.select("page_id", W.canonical_column(url).alias("canonical"), W.host_of(url).alias("host"), A.base_name(url).alias("name"))


def web_markdown(spark, sf_dir):
    return D.read(spark, sf_dir, "pages").select("page_id", W.to_markdown("html").alias("markdown"))


def _refs(spark, sf_dir):
    p = D.paragraphs(spark, sf_dir)
    n = F.col("ord").cast("string")
    html = F.concat(F.lit('<img alt="x" src="pics/'), n, F.lit('.PNG?v=1"> text ![alt](img/'), (_C("ord") % 5).cast("string"), F.lit('.png "t") <video src="v/'), (_C("doc_id") % 3).cast("string"), F.lit('.mp4">'))
    return A.references(p.withColumn("english", F.when(_C("ord") % 2 == 0, F.concat("english", html)).otherwise(_C("english"))))


def asset_refs(spark, sf_dir):
    return _refs(spark, sf_dir).select("doc_id", "raw", "kind", "chapter_id")


def asset_match_report(spark, sf_dir):
    files = spark.range(0, 40).select(F.concat(F.lit("store/"), F.when(_C("id") % 2 == 0, F.concat((_C("id")).cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("."), _C("id").cast("string"), F.lit(".png")))).alias("path"))
    out = A.report(A.match(_refs(spark, sf_dir), A.local_files(files)))
    return out.select("doc_id", "total", "local_matched", "missing", F.array_join("missing_samples", "|").alias("samples"))


def manifest_entries(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents")
    docs = d.select("doc_id", F.concat("source", F.lit(".md")).alias("filename"), _C("lang").alias("file_type"), (_C("n_chars") % 100).cast("int").alias("total_paragraphs"))
    chapters = d.select("doc_id", F.posexplode(F.array("source", "source", "text", F.upper("lang"), F.concat("lang", F.lit(" "), "source"), "lang")).alias("ch_ord", "title"))
    cards = D.read(spark, sf_dir, "labels").select("doc_id")
    return E.manifest(docs, chapters, cards).select("doc_id", "title", "path", "paragraph_count", "flashcard_count", "type", F.array_join("tags", "|").alias("tags"), "description")


def render_markdown(spark, sf_dir):
    return E.render_chapters(D.paragraphs(spark, sf_dir), D.chapters(spark, sf_dir)).select("doc_id", "chapter_id", "markdown")


def full_markdown(spark, sf_dir):
    return E.full_markdown(E.render_chapters(D.paragraphs(spark, sf_dir), D.chapters(spark, sf_dir))).select("doc_id", F.length("markdown").alias("n"), F.sha2("markdown", 256).alias("sha256"))


def seo_descriptions(spark, sf_dir):
    return E.seo(D.paragraphs(spark, sf_dir))


def recent_documents(spark, sf_dir):
    d = D.read(spark, sf_dir, "orders").select("o_orderkey", F.when(_C("o_orderkey") % 7 == 0, "").otherwise(F.date_format(_C("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("created_at"))
    return d.orderBy(F.coalesce("created_at", F.lit("")).desc(), "o_orderkey").select("o_orderkey", "created_at")


def preferred_order(spark, sf_dir):
    pref = F.array(*map(F.lit, ("FRANCE", "JAPAN", "BRAZIL", "NOWHERE")))
    n = D.read(spark, sf_dir, "nation")
    place = F.array_position(pref, _C("n_name"))
    w = Window.orderBy(F.when(place > 0, place).otherwise(F.lit(99)), "n_name")
    return n.where(~_C("n_name").rlike("^(INDIA|IRAN)$")).select("n_name", F.row_number().over(w).alias("pos"))


def model_union(spark, sf_dir):
    r, n, c = (D.read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return r.select(_C("r_name").alias("id")).union(n.select("n_name")).union(c.select("c_mktsegment")).distinct()


def flashcard_blocks(spark, sf_dir):
    text = F.concat("content", F.lit("\n:::flashcard\ntype: qa\nfront: Q "), _C("turn").cast("string"), F.lit("\nmore\n答案：A\ntags: #a，b\n:::\nend"))
    out = answers.explode_cards(D.messages(spark, sf_dir).withColumn("t", text), ["conv_id", "turn"], "t")
    return out.select("conv_id", "turn", "card_index", "type", "front", "back", F.array_join("tags", "|").alias("tags"))


def translations_parsed(spark, sf_dir):
    out = F.concat(F.lit("<think>x</think>译文：> 前文参考\n> a\n---\n> 译一\n> 译二 "), _C("turn").cast("string"), F.lit("\n\n> 第三 "), F.regexp_replace("content", r"\s+", " "))
    return D.messages(spark, sf_dir).select("conv_id", "turn", answers.translation(out).alias("parsed"))


def translation_prompts(spark, sf_dir):
    from lectern.operators.context import last_readable

    rows = last_readable(D.paragraphs(spark, sf_dir), ["doc_id"], "ord", "english", ["chinese"])
    return rows.select("doc_id", "ord", answers.translation_prompt(_C("english"), _C("previous.english"), _C("previous.chinese")).alias("prompt"))


def anki_packages(spark, sf_dir):
    d = D.lines(spark, sf_dir)  # a card for each line, a deck for each document
    cards = d.select("doc_id", F.lpad(_C("ord").cast("string"), 6, "0").alias("id"), F.lit("qa").alias("type"), F.left("raw", F.lit(40)).alias("front"), F.substring(_C("raw"), F.lit(41), F.length("raw")).alias("back"), F.array(F.lit("line")).alias("tags"), F.struct(F.lit(1).alias("reps"), F.lit(0).alias("lapses"), F.lit(6).alias("interval_days"), F.lit(2.5).alias("ease_factor")).alias("stats"))
    return E.anki_packages(cards, 1_706_700_000).select("doc_id", "n_notes", (F.length("apkg") > 0).alias("packed"))


def _books(spark, sf_dir, documents=None, empty=False):
    p, c = D.paragraphs(spark, sf_dir), D.chapters(spark, sf_dir)
    if documents is None:
        documents = D.read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" & <b>")).alias("filename"))
    return E.html_book(E.render_chapters(p, c), documents, c, E.seo(p), empty=empty)


def html_books(spark, sf_dir):
    part = lambda x: F.regexp_extract("html", x, 1)
    words, said = part('(?s)<meta name="keywords" content="(.*?)">'), part('(?s)<meta name="description" content="(.*?)">')
    return _books(spark, sf_dir).select("doc_id", part("(?s)<title>(.*?)</title>").alias("title"), said.alias("description"), words.alias("keywords"), part("(?s)<ol>(.*?)</ol>").alias("contents"), (F.size(F.split("html", "<section id=")) - 1).alias("sections"))


def card_payloads(spark, sf_dir):
    return E.card_payload(D.lines(spark, sf_dir).select("doc_id", _C("ord").alias("id"), F.lit("qa").alias("type"), _C("raw").alias("front"), F.array(F.lit("line")).alias("tags")))


def library_bundle(spark, sf_dir):
    d = D.read(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("")))
    entries = d.select("doc_id", F.concat("source", F.lit(".md")).alias("title"), F.concat(F.lit("docs/"), F.coalesce(_C("doc_id").cast("string"), F.lit("")), F.lit("/index.html")).alias("path"), F.lit("a & b").alias("description"))
    titles = d.where("doc_id is not null").groupBy("doc_id").agg(F.concat(F.min("source"), F.lit(" & <b>")).alias("filename"))
    files = E.library_files(entries, _books(spark, sf_dir, titles, empty=True), "https://library.example", 60).unionByName(E.portal_page(entries))
    urls, items = F.size(F.split("content", "<loc>")) - 1, F.coalesce(F.size(F.from_json("content", "array<struct<path:string>>")), F.lit(-1))
    kind = F.regexp_extract("path", "^(docs/|docs-|sitemap-|index)", 1)
    return files.groupBy(kind.alias("kind")).agg(F.countDistinct("path").alias("files"), F.sum(F.when(kind == "sitemap-", urls).when(kind == "docs-", items).otherwise(F.size(F.split("content", "<li>")) - 1)).alias("entries"))


def sse_frames(spark, sf_dir):
    return D.messages(spark, sf_dir).select("conv_id", "turn", E.sse(F.struct(_C("role").alias("role"), _C("turn").alias("n"), _C("content").alias("content"))).alias("frame"))


QUERIES = {f.__name__: f for f in (
    web_titles, web_sidebar_links, web_url_canonical, web_markdown, asset_refs, asset_match_report, manifest_entries, render_markdown, full_markdown, seo_descriptions, recent_documents, preferred_order, model_union,
    flashcard_blocks, translations_parsed, translation_prompts, anki_packages, sse_frames, html_books, card_payloads, library_bundle,
)}

_CLEAN = "regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
_TAGLESS = lambda x: f"regexp_replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '¶', ''), '^\\s+|\\s+$', '', 'g')"
_URL = "concat(url, case page_id % 5 when 0 then '' when 1 then '/' when 2 then '?a=1' when 3 then '#x' else ';p?q#r' end)"
_REFS = """(with p as (select doc_id, ord, chapter_id, case when ord % 2 = 0 then concat(english, '<img alt="x" src="pics/', cast(ord as string), '.PNG?v=1"> text ![alt](img/', cast(ord % 5 as string), '.png "t") <video src="v/', cast(doc_id % 3 as string), '.mp4">') else english end as english, chinese from {paragraphs} p),
  r as (select doc_id, chapter_id, ord, 0 as k, 'html_img' as kind, unnest(regexp_extract_all(english, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1)) as raw from p
    union all select doc_id, chapter_id, ord, 1, 'md_img', string_split(unnest(regexp_extract_all(english, '!\\[(.*?)\\]\\((.*?)\\)', 2)), ' ')[1] from p
    union all select doc_id, chapter_id, ord, 2, 'media', unnest(regexp_extract_all(english, '(?i)<(?:video|audio)[^>]+src=["'']([^"'']+)["'']', 1)) from p)
  select doc_id, raw, kind, chapter_id from (select *, row_number() over (partition by doc_id, raw order by chapter_id, ord, k) as n from r where raw <> '') t where n = 1)"""
_MD = "concat(trim(english), chr(10), chr(10), case when type <> 'image' and trim(chinese) <> '' then concat('> ', replace(trim(chinese), chr(10), concat(chr(10), '> ')), chr(10), chr(10)) else '' end, '---', chr(10), chr(10))"
_RENDERED = f"(select doc_id, chapter_id, ch_ord, concat('# Chapter ', cast(ch_ord + 1 as string), chr(10), chr(10), string_agg({_MD}, '' order by ord)) as markdown from {{paragraphs}} p group by 1, 2, 3)"
_PROMPT = """concat(case when coalesce(pe, '') = '' then '' else concat('【前文】', chr(10), pe, case when coalesce(pc, '') <> '' then concat(chr(10), '【前文译文】', chr(10), pc) else '' end, chr(10), chr(10)) end, '【待翻译段落】', chr(10), english)"""

ORACLES = {k: D.duck(v) for k, v in {
    "web_titles": f"""select page_id, case when h <> '' then h else trim(string_split(string_split(t, ' - ')[1], ' | ')[1]) end as page_title, case when t <> '' then t else h end as site_title
        from (select page_id, {_TAGLESS(f"regexp_extract({_CLEAN}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as h, trim(regexp_extract({_CLEAN}, '(?is)<title[^>]*>(.*?)</title>', 1)) as t from pages) x""",
    "web_url_canonical": f"select page_id, rtrim(regexp_replace(u, '[;?#].*$', ''), '/') as canonical, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, lower(regexp_extract(regexp_replace(u, '[?#].*$', ''), '([^/]*)$', 1)) as name from (select page_id, {_URL} as u from pages) t",
    "asset_refs": f"select * from {_REFS} t",
    "asset_match_report": f"""with m as (select doc_id, raw, lower(regexp_extract(regexp_replace(raw, '[?#].*$', ''), '([^/]*)$', 1)) in (select concat(cast(i as string), '.png') from range(0, 40, 2) r(i)) as hit from {_REFS} t),
        n as (select *, row_number() over (partition by doc_id, hit order by encode(raw)) as k from m)
        select doc_id, count(*) as total, count(*) filter (hit) as local_matched, count(*) filter (not hit) as missing, coalesce(string_agg(raw, '|' order by k) filter (not hit and k <= 20), '') as samples from n group by doc_id""",
    "manifest_entries": """with t as (select doc_id, upper(lang) as a, [source, source, text, upper(lang), concat(lang, ' ', source), lang] as c from documents),
        u as (select doc_id, unnest(list_concat([a], [x for x in c if length(x) between 1 and 8])) as g, generate_subscripts(list_concat([a], [x for x in c if length(x) between 1 and 8]), 1) as i from t),
        v as (select doc_id, g, min(i) as i from u group by 1, 2), w as (select doc_id, g, i, row_number() over (partition by doc_id order by i) as k from v), x as (select doc_id, string_agg(g, '|' order by i) as tags from w where k <= 4 group by 1),
        l as (select doc_id, count(*) as n from labels group by 1)
        select d.doc_id, concat(source, '.md') as title, concat('docs/', cast(d.doc_id as string), '/index.html') as path, cast(n_chars % 100 as int) as paragraph_count, coalesce(n, 0) as flashcard_count, lang as type, tags,
          concat('共包含 ', cast(n_chars % 100 as string), ' 个研学段落，配套 ', cast(coalesce(n, 0) as string), ' 个考点记忆闪卡。') as description from documents d join x on d.doc_id = x.doc_id left join l on d.doc_id = l.doc_id""",
    "render_markdown": f"select doc_id, chapter_id, markdown from {_RENDERED} r",
    "full_markdown": f"select doc_id, cast(length(m) as int) as n, sha256(m) as sha256 from (select doc_id, string_agg(markdown, concat(chr(10), chr(10)) order by ch_ord) as m from {_RENDERED} r group by doc_id) t",
    "seo_descriptions": """with t as (select doc_id, ord, trim(coalesce(nullif(chinese, ''), english, '')) as r from {paragraphs} p), c as (select *, trim(regexp_replace(regexp_replace(r, '[*_`#\\[\\]]', '', 'g'), '\\s+', ' ', 'g')) as c from t where r <> '' and not starts_with(r, '![')),
        n as (select *, row_number() over (partition by doc_id order by ord) as k from c where length(c) > 20)
        select doc_id, concat(trim(left(string_agg(c, ' ' order by k), 150)), '...') as description from n where k <= 3 group by doc_id""",
    "recent_documents": "select o_orderkey, case when o_orderkey % 7 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as created_at from orders",
    "preferred_order": "select n_name, cast(row_number() over (order by case n_name when 'FRANCE' then 1 when 'JAPAN' then 2 when 'BRAZIL' then 3 else 99 end, n_name) as int) as pos from nation where n_name not in ('INDIA', 'IRAN')",
    "model_union": "select r_name as id from region union select n_name from nation union select c_mktsegment from customer",
    "flashcard_blocks": "select conv_id, turn, 0 as card_index, 'qa' as type, concat('Q ', cast(turn as string), chr(10), 'more') as front, 'A' as back, 'a|b' as tags from {messages} m",
    "translations_parsed": "select conv_id, turn, concat('译一译二 ', cast(turn as string), chr(10), chr(10), trim(concat('第三 ', regexp_replace(content, '\\s+', ' ', 'g')))) as parsed from {messages} m",
    "translation_prompts": f"""with r as (select doc_id, ord, english, chinese, case when type in ('text', 'scanned_page') and trim(english) <> '' then ord end as ok from {{paragraphs}} p),
        m as (select doc_id, ord, english, max(ok) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as p from r)
        select m.doc_id, m.ord, {_PROMPT} as prompt from (select m.doc_id, m.ord, m.english, r.english as pe, r.chinese as pc from m left join r on m.doc_id = r.doc_id and m.p = r.ord) m""",
    "anki_packages": "select doc_id, cast(count(*) as int) as n_notes, true as packed from {lines} l group by doc_id",
    "html_books": """with t as (select doc_id, ord, trim(coalesce(nullif(chinese, ''), english, '')) as r from {paragraphs} p), c as (select *, trim(regexp_replace(regexp_replace(r, '[*_`#\\[\\]]', '', 'g'), '\\s+', ' ', 'g')) as c from t where r <> '' and not starts_with(r, '![')),
        n as (select *, row_number() over (partition by doc_id order by ord) as k from c where length(c) > 20), s as (select doc_id, concat(trim(left(string_agg(c, ' ' order by k), 150)), '...') as said from n where k <= 3 group by doc_id),
        h as (select distinct doc_id, ch_ord, chapter_id from {paragraphs} p), g as (select doc_id, string_agg(concat('Chapter ', cast(ch_ord + 1 as string)), ', ' order by ch_ord) filter (ch_ord < 10) as keywords, count(*) as n,
          string_agg(concat('<li><a href="#', chapter_id, '">Chapter ', cast(ch_ord + 1 as string), '</a></li>'), '' order by ch_ord) as contents from h group by doc_id)
        select d.doc_id, concat(source, ' &amp; &lt;b&gt;') as title, replace(replace(replace(replace(coalesce(said, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as description, keywords, contents, cast(n as int) as sections from documents d join g on d.doc_id = g.doc_id left join s on s.doc_id = d.doc_id""",
    "card_payloads": "select doc_id, cast(to_json(list({'id': ord, 'type': 'qa', 'front': raw, 'tags': ['line']} order by ord)) as string) as payload from {lines} l group by doc_id",
    "library_bundle": """with n as (select count(*) as n, count(distinct doc_id) as books, cast(ceil(count(*) / 60.0) as bigint) as parts from documents), l as (select count(*) as li from (select distinct doc_id, ch_ord from {paragraphs} p) q)
        select 'docs/' as kind, books as files, cast(li as bigint) as entries from n, l union all select 'docs-', parts, n from n union all select 'sitemap-', parts, n from n union all select 'index', 1, least(n, 100) from n""",
    "sse_frames": "select conv_id, turn, concat('data: {\"role\":\"', role, '\",\"n\":', cast(turn as string), ',\"content\":', cast(to_json(content) as string), '}', chr(10), chr(10)) as frame from {messages} m",
}.items()}
