"""Helpers: joins that deal hot keys out, and the shared folder."""

from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import common


def test_join_spread_gives_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    rows = [(i, 7 if i % 2 else i % 40, f"v{i}") for i in range(3000)]
    big = spark.createDataFrame(rows, "id long, k long, v string")
    few = common.written(big.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 3"), "test-few")
    got = common.join_spread(big, few, ["k"], "n", ["id"])
    assert got.columns == ["id", "k", "v", "n", "top"]
    count, top = Counter(k for _, k, _ in rows), {k: i for i, k, _ in rows}
    assert sorted(map(tuple, got.collect())) == sorted((i, k, v, count[k], top[k]) for i, k, v in rows if k != 3)
    assert common.join_spread(big.limit(0), few.limit(0), ["k"], "n", ["id"]).count() == 0


def test_join_few_with_and_without_broadcast(spark):
    big = spark.range(100).select(F.col("id"), (F.col("id") % 5).alias("k"))
    few = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    for limit in (0, common.BROADCAST_BYTES):
        assert common.join_few(big, few, "k", "inner", limit=limit).count() == 40
        assert common.join_few(big, few, ["k"], "left_anti", limit=limit).count() == 60


def test_clean_up_removes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/lectern-app")
    assert common.written(spark.range(5), "test-five").count() == 5
    assert list(tmp_path.glob("lectern-app/test-five-*"))
    common.clean_up(spark)
    assert not list(tmp_path.glob("lectern-*"))


def test_shared_dir_is_within_the_setting(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
