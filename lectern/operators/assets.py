"""Asset references in paragraphs, matched to local files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip

# The three kinds of reference, in the order in which they are looked for.
PATTERNS = (
    ("html_img", r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1),
    ("md_img", r"!\[(.*?)\]\((.*?)\)", 2),
    ("media", r"""(?i)<(?:video|audio)[^>]+src=["']([^"']+)["']""", 1),
)
FIELDS = ("english", "source_text", "translated_text", "chinese")


def can_inspect(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("file_type").isin("web", "folder", "zip") & ~F.coalesce("is_scanned", F.lit(False)))


def _numbered(found: Column, field: int, pattern: int, kind: str) -> Column:
    """Found references with their place among fields, patterns and matches."""
    return F.transform(found, lambda x, i: F.struct(F.lit(field).alias("f"), F.lit(pattern).alias("p"), i.alias("i"), F.lit(kind).alias("kind"), F.split(strip(x), r"\s+")[0].alias("raw")))


def references(paragraphs: DataFrame, doc: str = "doc_id", chapter: str = "chapter_id", order: str = "ord") -> DataFrame:
    """doc, raw, kind, chapter: distinct references of each document; the first occurrence gives kind and chapter."""
    fields = [c for c in FIELDS if c in paragraphs.columns]
    parts = []
    for f, name in enumerate(fields):
        for p, (kind, pattern, group) in enumerate(PATTERNS):
            found = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(pattern), F.lit(group))
            parts.append(_numbered(found, f, p, kind))
    rows = paragraphs.select(doc, chapter, order, F.explode(F.concat(*parts)).alias("r")).where(F.col("r.raw") != "")
    first = rows.groupBy(doc, F.col("r.raw").alias("raw")).agg(F.min(F.struct(F.col(chapter).alias("c"), F.col(order).alias("o"), F.col("r.f").alias("f"), F.col("r.p").alias("p"), F.col("r.i").alias("i"), F.col("r.kind").alias("kind"))).alias("m"))
    return first.select(doc, "raw", F.col("m.kind").alias("kind"), F.col("m.c").alias(chapter))


def base_name(path: Column) -> Column:
    """Lower-case file name of a path or URL, percent signs decoded."""
    bare = F.substring_index(F.substring_index(path, "#", 1), "?", 1)
    return F.lower(F.try_url_decode(F.replace(F.regexp_extract(bare, "([^/]*)$", 1), F.lit("+"), F.lit("%2B"))))


def local_files(files: DataFrame, path: str = "path") -> DataFrame:
    """key and path of files that aren't hidden; of equal names the last."""
    seen = files.where(~F.col(path).rlike(r"(^|/)\.")).select(base_name(F.col(path)).alias("key"), F.col(path).alias("path"))
    return seen.groupBy("key").agg(F.max("path").alias("path"))


def match(refs: DataFrame, local: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """refs with key, path and matched, from local files (key, path), else from the paths in the source (key, path)."""
    keyed = refs.withColumn("key", base_name(F.col("raw")))
    out = keyed.join(local.select("key", F.col("path").alias("_local")), "key", "left")
    if sources is not None:
        out = out.join(sources.groupBy("key").agg(F.max("path").alias("_source")), "key", "left")
    path = F.coalesce("_local", "_source") if sources is not None else F.col("_local")
    return out.withColumn("path", path).withColumn("matched", path.isNotNull()).drop("_local", "_source")


def report(matched: DataFrame, doc: str = "doc_id", shown: int = 20) -> DataFrame:
    """total, local_matched, missing, and the first missing references in order of their text."""
    w = Window.partitionBy(doc, "matched").orderBy("raw")
    rows = matched.withColumn("_n", F.row_number().over(w))
    listed = F.array_sort(F.collect_list(F.when(~F.col("matched") & (F.col("_n") <= shown), F.col("raw"))))
    return rows.groupBy(doc).agg(F.count("*").alias("total"), F.count_if("matched").alias("local_matched"), F.count_if(~F.col("matched")).alias("missing"), listed.alias("missing_samples"))


def rewrite(paragraphs: DataFrame, mapping: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Paragraphs with references replaced in all text fields by their local paths (doc, raw, path), longest references first."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(F.length("raw").alias("n"), "raw", "path"))))
    maps = mapping.groupBy(doc).agg(ordered.alias("_map"))
    out = paragraphs.join(maps, doc, "left")
    for name in [c for c in FIELDS if c in paragraphs.columns]:
        new = F.aggregate(F.coalesce("_map", F.array().cast("array<struct<n:int,raw:string,path:string>>")), F.col(name), lambda a, m: F.replace(a, m["raw"], m["path"]))
        out = out.withColumn(name, new)
    return out.select(paragraphs.columns)


def apply_plan(paragraphs: DataFrame, plans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Paragraphs rewritten by the rules of a model's plan (doc, plan: JSON with rules of from and to), longest `from` first; what isn't JSON does nothing."""
    rules = F.from_json("plan", "rules array<struct<`from`:string,`to`:string>>")["rules"]
    each = plans.select(doc, F.explode(rules).alias("r")).where(F.coalesce(F.col("r")["from"], F.lit("")) != "")
    return rewrite(paragraphs, each.select(doc, F.col("r")["from"].alias("raw"), F.coalesce(F.col("r")["to"], F.lit("")).alias("path")).distinct(), doc)


def single_flight(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The first request for each key: later ones for the same key share its work."""
    w = Window.partitionBy(key).orderBy(order)
    return requests.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
