"""Fetching by host in rounds of attempts."""

from pyspark.sql import functions as F

from lectern.sources import fetch


def test_rounds_failures_and_order_within_hosts(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def call(url):
        import uuid
        from pathlib import Path
        from time import time_ns

        (Path(str(log)) / f"{time_ns():020d}-{uuid.uuid4().hex}").write_text(str(url))
        seen = sum(p.read_text() == str(url) for p in Path(str(log)).iterdir())
        if url is None or "dead" in url or ("slow" in url and seen < 2):
            raise TimeoutError("" if url is None else f"no answer from {url}")
        return f"<p>{url}</p>"

    urls = [f"https://h{i % 3}.example/{'slow' if i % 4 == 1 else 'dead' if i == 7 else 'page'}/{i}" for i in range(12)] + [None, "no host", "https://H0.example/page/x"]
    targets = spark.createDataFrame(list(enumerate(urls)), "n int, url string")
    got = {r.n: r for r in fetch.crawl(targets, fetch.by_host(call, hosts=2), attempts=3).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        lost = url is None or "dead" in url
        assert got[i].fetch_success == (not lost) and got[i].html == (None if lost else f"<p>{url}</p>")
        assert got[i].attempts == (3 if lost else 2 if "slow" in url else 1)
        assert got[i].error == (None if not lost else "TimeoutError" if url is None else f"no answer from {url}")
    calls = [p.read_text() for p in sorted(log.iterdir())]
    first = [u for u in dict.fromkeys(calls) if u.lower().startswith("https://h0")]
    assert first == [u for u in urls if u and u.lower().startswith("https://h0")]  # in order of selection
    assert len(calls) == sum(r.attempts for r in got.values())


def test_no_targets(spark):
    empty = spark.createDataFrame([], "n int, url string")
    assert fetch.crawl(empty, fetch.by_host(lambda url: url)).count() == 0
    assert fetch.crawl(empty, lambda todo: todo.withColumns({"html": F.lit("x"), "error": F.lit(None).cast("string")})).count() == 0
