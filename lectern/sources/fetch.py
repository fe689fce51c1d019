"""Fetching pages: rounds of attempts over what hasn't come yet; the fetch function is a parameter, the network is not ours.

A fetch function takes rows (n, url, host, attempt) and gives them back with html and error, one of them null. `by_host` makes one from a
Python function of a URL: rows are dealt out by host, each host is one task's and is asked one page after another with a pause between, and at
most `hosts` tasks, and so hosts, are in flight. A hot host is one task's, as politeness to it asks; it holds up no other host's task.

Each round is written before it counts, so a lost executor repeats its own hosts of that round alone. Defined cases: a null or repeated URL is
a row of its own; a URL without a host is dealt by itself; a call that raises is an error row; no targets give no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sinks.versions import settled

FIELDS = ["n", "url", "host", "attempt"]


def by_host(call: Callable[[str], str], hosts: int = 8, pause: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    def fetch(todo: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.select(*FIELDS).schema)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            before = None
            for pdf in batches:
                for n, url, host, attempt in pdf[FIELDS].itertuples(index=False):
                    if before == host and pause:
                        time.sleep(pause)
                    before = host
                    try:
                        html, error = call(url), None
                    except Exception as e:  # a fetch function may raise anything
                        html, error = None, str(e) or type(e).__name__
                    yield pd.DataFrame({"n": [n], "url": [url], "host": [host], "attempt": [attempt], "html": [html], "error": [error]})

        dealt = todo.repartition(hosts, "host").sortWithinPartitions("host", "n")
        return dealt.mapInPandas(run, f"{kinds}, html string, error string")

    return fetch


def crawl(targets: DataFrame, fetch: Callable[[DataFrame], DataFrame], attempts: int = 2) -> DataFrame:
    """n, url, html, error, attempts and fetch_success of every target (n, url; n tells them apart and is the order of selection).

    A target is tried again, up to `attempts` times in all, while it has no page; error is that of the last try.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    todo = targets.select("n", "url", F.when(host == "", F.concat(F.lit("?"), F.col("n").cast("string"))).otherwise(host).alias("host"))
    done = None
    for i in range(1, attempts + 1):
        got = settled(fetch(todo.withColumn("attempt", F.lit(i))).select(*FIELDS, "html", "error"), "fetched")
        missing = F.col("html").isNull()
        part = got if i == attempts else got.where(~missing)
        done = part if done is None else done.unionByName(part)
        todo = got.where(missing).select("n", "url", "host")
    return done.select("n", "url", "html", F.when(F.col("html").isNull(), F.coalesce("error", F.lit("empty"))).alias("error"), F.col("attempt").alias("attempts"), F.col("html").isNotNull().alias("fetch_success"))
