"""Row numbers over a whole table, links that images match, and progress."""

import random

from pyspark.sql import functions as F

from lectern.operators import ordering, status
from lectern.sinks import export


def test_numbers_follow_the_order(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "a", "b", "ä", "hot", "hot", "hot"]), i) for i in range(5000)]
    got = ordering.numbered(spark.createDataFrame(rows, "k string, i int").repartition(7), ["k", F.col("i").desc()], "place").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), -r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, 5001))
    assert ordering.numbered(spark.createDataFrame([], "k string"), ["k"], "place").count() == 0


def test_links_without_an_image_stay(spark):
    rows = spark.createDataFrame([(1, "![x](a/P.png) ![x](b/p.PNG?v) <img src='%70.png'> ![](p.png)"), (2, "![x](a/P.png)"), (3, None)], "doc_id int, markdown string")
    images = spark.createDataFrame([(1, "P.png")], "doc_id int, name string")
    got = {r.doc_id: r.markdown for r in export.relink_matched(rows, images, F.lit("img")).collect()}
    assert got == {1: "![x](img/P.png) ![x](b/p.PNG?v) <img src='img/P.png'> ![](img/P.png)", 2: "![x](a/P.png)", 3: None}


def test_documents_with_progress(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    read = spark.createDataFrame([(1, 40.0, False), (1, 60.0, None), (2, 3.0, True)], "doc_id int, ratio double, completed boolean")
    assert {r.doc_id: r.progress for r in status.with_progress(docs, read).collect()} == {1: 60.0, 2: 100.0, 3: None}
