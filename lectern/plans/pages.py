"""Queries on laid-out documents: the lines of all documents as spans with places, sizes and weights, and back to chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import pages as P
from lectern.sources import derive as D

#: Lines of a page, and its height.
PER_PAGE, HEIGHT = 12, 320
_PLACED = f"""(select doc_id, ord, cast(floor(ord / {PER_PAGE}) as int) + 1 as page, ord % {PER_PAGE} as k, line,
  cast(24 + (ord % {PER_PAGE}) * 24 + (ord + doc_id) % 3 * (ord % 5) as double) as y0, cast(case when (ord + doc_id) % 12 = 0 then 16 when (ord + doc_id) % 12 = 10 then 14 else 11 end as double) as size,
  cast(case when ord % 13 = 5 then 16 else 0 end as int) as flags, case when ord % 17 = 4 then 'Serif-Bold' else 'Serif' end as font from {{decorated}} d)"""
_LINE = f"case when k = 0 and page % 2 = 0 then 'Running title' when k = {PER_PAGE - 1} then concat('- ', cast(page as varchar(12)), ' -') else line end"
#: Two spans to a line, the second a little lower and, on some lines, in body type.
SPANS = f"""(select doc_id, page, cast(50 as double) as x0, y0, cast(122 as double) as x1, y0 + 12 as y1, substr(t, 1, 12) as text, size, flags, font from (select *, {_LINE} as t from {_PLACED} p) q
  union all select doc_id, page, cast(122 as double) as x0, y0 + 1 as y0, cast(500 as double) as x1, y0 + 12 as y1, substr(t, 13) as text, cast(11 as double) as size, cast(case when ord % 2 = 0 then flags else 0 end as int) as flags, font from (select *, {_LINE} as t from {_PLACED} p) q)"""
PAGES = f"(select distinct doc_id, page, cast({HEIGHT} as double) as height from {_PLACED} p)"
#: A table on every third page, found in two overlapping boxes on every sixth.
BOXES = f"""(select doc_id, page, cast(40 as double) as x0, cast(140 as double) as y0, cast(510 as double) as x1, cast(175 as double) as y1 from {PAGES} p where page % 3 = 1
  union all select doc_id, page, cast(60 as double) as x0, cast(170 as double) as y0, cast(520 as double) as x1, cast(196 as double) as y1 from {PAGES} p where page % 6 = 1)"""
IMAGES = f"""(select doc_id, page, cast(50 as double) as x0, cast(case when page % 4 = 0 then 150 else 84.5 end as double) as y0, cast(300 as double) as x1, cast(case when page % 4 = 0 then 170 else 100 end as double) as y1,
  concat('images/', cast(doc_id as varchar(20)), '_', cast(page as varchar(12)), '.png') as src from {PAGES} p where page % 2 = 0)"""
#: Tables of contents of two documents in three: some with one topmost entry, some titles as they stand on the page.
TOC = f"""(select doc_id, ord as n, case when doc_id % 2 = 0 and ord > 3 then 2 when ord % 24 = 3 then 1 else 3 end as level, substr(line, 1, 60) as title, page from {_PLACED} p where doc_id % 3 > 0 and ord % 12 = 3)"""


def _tables(spark, sf_dir):
    decorated = D.decorated(spark, sf_dir)
    return [spark.sql(f"select * from {sql} t", decorated=decorated) for sql in (SPANS, PAGES, BOXES, IMAGES, TOC)]


def laid_out_lines(spark, sf_dir):
    return P.lines_of(_tables(spark, sf_dir)[0]).select("doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1", "size", "bold")


def laid_out_chapters(spark, sf_dir):
    return P.document_chapters(*_tables(spark, sf_dir))


QUERIES = {f.__name__: f for f in (laid_out_lines, laid_out_chapters)}

# Chapters are compared with a plain reading of all documents by tests/test_pages.py.
ORACLES = {k: D.duck(v) for k, v in {
    "laid_out_lines": f"""with recursive s as (select *, row_number() over (partition by doc_id, page order by y0, x0, x1, text) as i from {SPANS} s where text <> ''),
        r as (select doc_id, page, i, y1 as low, 1 as ord from s where i = 1
          union all select s.doc_id, s.page, s.i, greatest(low, y1), case when (y0 + y1) / 2 >= low then ord + 1 else ord end from r join s on s.doc_id = r.doc_id and s.page = r.page and s.i = r.i + 1),
        l as (select s.doc_id, s.page, ord, trim(string_agg(text, '' order by x0, y0, text)) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, max(size) as size,
          sum(case when (flags & 16) > 0 or contains(lower(font), 'bold') then length(regexp_replace(text, '\\s', '', 'g')) else 0 end) as heavy, sum(length(regexp_replace(text, '\\s', '', 'g'))) as total
          from s join r on r.doc_id = s.doc_id and r.page = s.page and r.i = s.i group by all)
        select doc_id, page, ord, text, x0, y0, x1, y1, size, total > 0 and heavy >= 0.85 * total as bold from l where text <> ''""",
}.items()}
