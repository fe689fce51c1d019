"""Progress of streaming queries as a table: what each batch took in, with the metrics that its plan observes."""

from __future__ import annotations

import json
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, rows long, name string, metrics string"


class ProgressLog(StreamingQueryListener):
    """Keeps the events of the queries that run while it listens; one row for each batch that took rows in and each observation of it."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.open: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.changed:
            self.open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = {k: r.asDict() for k, r in (p.observedMetrics or {}).items()}
        if p.numInputRows:
            with self.changed:
                self.rows += [(p.name or str(p.id), p.batchId, p.numInputRows, k, json.dumps(v, default=str)) for k, v in (seen or {"": {}}).items()]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.changed:
            self.open.discard(str(event.runId))
            self.changed.notify_all()

    def wait(self, seconds: float) -> bool:
        """Whether all queries that were seen to start have been seen to end: events come a little after the queries."""
        with self.changed:
            return self.changed.wait_for(lambda: not self.open, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        """query, batch, rows, name of the observation and its metrics as JSON."""
        return spark.createDataFrame(self.rows, SCHEMA)


@contextmanager
def listening(spark: SparkSession, seconds: float = 60.0):
    """A ProgressLog of the queries that run inside; at its end, waits for the events that are still on their way."""
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        yield log
        log.wait(seconds)
    finally:
        spark.streams.removeListener(log)
