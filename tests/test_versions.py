"""Tables in versions, and translation that fails, stops and goes on."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import translation as T
from lectern.sinks.versions import VersionedTable

SCHEMA = "k int, g string, v string"


def rows(df):
    return sorted(((r.k, r.g, r.v) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["k", "g"], SCHEMA)


def make(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_versions_of_keys_with_nulls(spark, table):
    assert rows(table.read()) == []
    table.upsert(make(spark, (1, "a", "x"), (2, None, "y")))
    table.upsert(make(spark, (2, None, "z"), (3, "c", "w")))
    assert rows(table.read()) == [(1, "a", "x"), (2, None, "z"), (3, "c", "w")]
    assert rows(table.read(1)) == [(1, "a", "x"), (2, None, "y")]
    table.upsert(make(spark))
    table.save(make(spark, (9, "q", "r")), "replace")
    assert rows(table.read()) == [(9, "q", "r")] and len(rows(table.read(3))) == 3
    table.upsert(make(spark, (9, "q", "a"), (9, "q", "c"), (9, "q", "b")), order=["v"])
    assert rows(table.read()) == [(9, "q", "c")]
    before = rows(table.read())
    table.compact()
    assert rows(table.read()) == before and table.history()[-1][1].mode == "replace"


def test_unpublished_writes_are_not_seen_and_are_cleared(spark, table):
    table.save(make(spark, (1, "a", "x")))
    lost = table.write(make(spark, (1, "a", "lost"), (5, "b", "lost")))
    assert rows(table.read()) == [(1, "a", "x")]
    assert table.vacuum() == [lost.folder]
    assert rows(table.read()) == [(1, "a", "x")]
    with pytest.raises(ValueError):
        table.write(make(spark), "append")


def test_two_writers_of_one_version(spark, table):
    table.save(make(spark, (1, "a", "x")))
    one, two = table.write(make(spark, (1, "a", "one"))), table.write(make(spark, (1, "a", "two")))
    assert table.publish(one, expected=1) == 2
    with pytest.raises(ValueError, match="published after"):
        table.publish(two, expected=1)
    seen, table.history = table.history, lambda: seen_before
    seen_before = seen()[:1]
    with pytest.raises(Exception, match="FileAlreadyExists"):  # the other writer came between its look and its rename
        table.publish(two)
    table.history = seen
    assert rows(table.read()) == [(1, "a", "one")]


def test_columns_that_come_later_are_null_before(spark, table):
    table.save(make(spark, (1, "a", "x")))
    table.upsert(make(spark, (2, "b", "y")).withColumn("more", F.lit(7)))
    assert {(r.k, r.more) for r in table.read().collect()} == {(1, None), (2, 7)}


def test_a_run_that_dies_keeps_whole_batches(spark, tmp_path):
    schema = "doc_id int, chapter_id string, id string, ord int, type string, english string, chinese string, status string, no_translate boolean"
    data = [(d, "c", f"p{i}", i, "code" if i == 4 else "text", f"line {i}", "" if i else "old", "pending" if i else "completed", i == 5) for d in range(4) for i in range(7)]
    p = spark.createDataFrame(data, schema)
    table = T.results_table(spark, f"file://{tmp_path}/r", p)

    def dies(todo):
        return todo.withColumn("chinese", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("gone"))).otherwise(F.lit("done")).cast("string"))

    with pytest.raises(Exception, match="gone"):
        T.translate_pending(p, table, dies, F.col("doc_id"), 4)
    assert {r.doc_id for r in table.read().collect()} == {0, 1}
    status = {r.doc_id: (r.status, r.completed, r.total) for r in T.run_status(p, table.read(), stopped=True).collect()}
    assert status == {0: ("completed", 5, 5), 1: ("completed", 5, 5), 2: ("paused", 1, 5), 3: ("paused", 1, 5)}
    assert T.translate_pending(p, table, lambda d: d.withColumn("chinese", F.lit(None).cast("string")), F.col("doc_id"), 4) == 4
    now = T.current(p, table.read()).where("id = 'p1'").orderBy("doc_id").collect()
    assert [(r.status, r.attempts) for r in now] == [("completed", 1), ("completed", 1), ("error", 1), ("error", 1)]
    assert {r.status for r in T.run_status(p, table.read(), stopped=False).where("doc_id > 1").collect()} == {"error"}
