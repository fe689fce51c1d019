"""Row numbers over a total order of a whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sinks.versions import settled

_INNER = 33  # bits of a row's place within its partition, as monotonically_increasing_id has them


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with `name`, their place from 1 in the given order.

    Rows are dealt out by ranges of the order, sorted within them, written, and numbered within each range; the ranges' sizes (a row for
    each partition) then give each its start. Nulls come first. Rows equal in all of the order share a range and stand in any order
    there, so the order should end with what tells rows apart.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", _INNER)
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy(part.alias("_part")).count().collect())
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = placed.sparkSession.createDataFrame(starts, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_at").bitwiseAND((1 << _INNER) - 1) + F.col("_before") + 1).select(*rows.columns, name)
