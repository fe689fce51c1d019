"""Reviews as a stream: the same states as the fold, late and repeated reviews, and timers."""

import random

from pyspark.sql import functions as F

from lectern.functions.scheduling import replay
from lectern.streaming import reviews as R


def test_one_review_is_that_of_the_columns(spark):
    rnd = random.Random(3)
    data = [(c, i, rnd.choice([-1, 0, 1, 2, 3, 4, 5, 9]), 1_700_000_000 + i * rnd.randint(1, 90_000)) for c in range(60) for i in range(rnd.randint(1, 40))]
    want = {r.c: tuple(r.stats) for r in replay(spark.createDataFrame(data, "c int, i int, rating int, at long"), "c", ["i"], "rating", "at").collect()}
    for c in want:
        s = R.State()
        for _, _, rating, at in sorted(r for r in data if r[0] == c):
            s = R.reviewed(s, rating, at)
        assert tuple(s) == want[c]


def test_late_repeated_and_due(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "card int, rating int, at long, no long"
    second = 1_000_000
    files = [[(1, 4, 100 * second, 1), (1, 4, 300 * second, 3), (2, 1, 50 * second, 9)], [(1, 1, 200 * second, 2), (1, 4, 100 * second, 1), (3, 3, 10 * second, 4)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        out = R.run_reviews(source, "card", f"{base}/out", f"{base}/check")
    got = {r.card: r for r in R.last_states(out, "card").collect()}
    every = spark.createDataFrame(sorted(set(files[0] + files[1])), schema).withColumn("at", F.col("at") / second).withColumn("at", F.col("at").cast("long"))
    want = {r.card: r.stats for r in replay(every, "card", ["at", "no"], "rating", "at").collect()}
    assert {c: tuple(r)[1:] for c, r in got.items()} == {c: tuple(s) for c, s in want.items()}
    assert got[1].lapses == 1 and got[1].reps == 1  # the late failure came between the two
    assert {r.card for r in out.where("kind = 'due'").collect()} == {2}  # card 1 was reviewed again in the batch in which its time had come
