"""Cases of the fourth round's findings: each failed before it was mended."""

from pyspark.sql import functions as F

from lectern.llm import common, graph, near_dup, quality


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def near_copies(spark):
    return spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: (i + (F.col("id") % 4) * 1000).cast("string")), (F.col("id") % 3).cast("string")).alias("text"))


def test_keys_of_near_duplicates_are_not_broadcast(spark, monkeypatch):
    """84 rows for each class, which Spark takes for as few bytes as the classes' files."""
    plans = {}

    def noted(df, label, *more):
        plans.setdefault(label, []).append(plan(df))
        return common.written(df, label, *more)

    monkeypatch.setattr(near_dup, "written", noted)
    monkeypatch.setattr(graph, "written", noted)
    out = near_dup.link(near_copies(spark))
    assert "Generate" in plans["near-ties"][0]
    assert not [x for label in ("near-ties", "near-links") for x in plans[label] if "BroadcastHashJoin" in x]
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, i % 4) for i in range(40)}


def test_tables_measured_as_large_are_not_broadcast(spark):
    """F2"""
    few = spark.range(30).withColumn("v", F.col("id") + 1)
    for how, rows in (("inner", 30), ("left", 50), ("left_semi", 30), ("left_anti", 20)):
        out = common.join_few(spark.range(50), few, "id", how, limit=0)
        assert "Broadcast" not in plan(out) and out.count() == rows
        assert "Broadcast" in plan(common.join_few(spark.range(50), few, "id", how))


def test_failing_hosts_that_are_many_are_not_broadcast(spark, monkeypatch):
    """beyond BROADCAST_HOSTS each comes 32 times, which Spark takes for as few bytes as once."""
    judged = spark.range(60).select((F.col("id") % 3).cast("string").alias("host"), (F.col("id") % 3 < 2).alias("base_failed"))
    few = quality.with_verdicts(judged, "host")
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    many = quality.with_verdicts(judged, "host")
    assert "Generate" in plan(many) and "Broadcast" not in plan(many)
    assert sorted(many.collect()) == sorted(few.collect()) and many.where("host_failed").count() == 40


def as_sql(spark, path, name, rows, columns="doc_id long, text string, lang string, source string", tables=("labels",)):
    """Rows of a query on documents, in order, and those of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(rows, columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", *tables):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    order = lambda found: sorted(map(tuple, found), key=repr)
    return order(entry.queries()[name](spark, str(path)).collect()), order(con.execute(entry.oracle_sql()[name]).fetchall())


ODD = ["", " ", None, "\n \n", " " * 70 + "later", "  ", "　front　", "\u000bab\u000b", "\tfront\n", "<li> a\nb"]


def test_cards_of_odd_documents(spark, tmp_path):
    """F3"""
    rows = [(10 * k + i, text, "en", "src") for k, text in enumerate(ODD) for i in range(5)] + [(None, "a", "en", "src"), (201, "a", None, "src"), (202, "a", "en", None), (203, None, None, None)]
    got, want = as_sql(spark, tmp_path, "card_create", rows)
    assert len(want) == 43 and got == want


def test_cards_with_blank_fronts_are_left_out_elsewhere(spark):
    """the operator's own rule stays."""
    from lectern.operators import cards

    new = spark.createDataFrame([(k, text) for k, text in enumerate(ODD)], "doc_id long, front string").select("*", *(F.lit("").alias(c) for c in ("chapter_id", "paragraph_id", "type", "back", "tags")))
    made = cards.create_cards(new.limit(0).select("doc_id", F.lit("").alias("id")), new)
    assert sorted((r.doc_id, r.front) for r in made.collect()) == [(4, "later"), (6, "front"), (7, "ab"), (8, "front"), (9, "<li> a\nb")]


def test_library_has_a_book_of_each_document(spark, tmp_path):
    """F4"""
    rows = [(k, text, "en", "src") for k, text in enumerate(ODD)] + [(100 + k, "a\nb\nc\nd\ne\nf", None, None) for k in range(70)] + [(100, "again", "en", "src"), (None, "", "en", "src")]
    got, want = as_sql(spark, tmp_path, "library_bundle", rows)
    assert dict((kind, files) for kind, files, _ in want) == {"docs/": 80, "docs-": 2, "sitemap-": 2, "index": 1} and got == want
