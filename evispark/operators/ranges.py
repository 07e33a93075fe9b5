"""Answers that depend on a global order, without one task that sees all rows.

Spark sorts by ranges. Each range is one partition of the sorted table, which is written once; what a range adds to the
ranges after it is one number, so that the driver only sees as many numbers as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.checkpoints import cut


def ranged(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with the number of their range in ``order``; ranges follow each other in that order."""
    return cut(rows.orderBy(*order).withColumn(name, F.spark_partition_id()))


def running(rows: DataFrame, order: list[Column], value: Column, name: str, most: int | None = None) -> DataFrame:
    """``rows`` with the running sum of ``value`` in ``order`` (a total order); with ``most``, only those up to which it fits."""
    at, own = "range of running sum", "value of running sum"
    sized = ranged(rows.withColumn(own, value), order, at)
    sums = sorted((r[at], r["n"] or 0) for r in sized.groupBy(at).agg(F.sum(own).alias("n")).collect())
    before, total = {}, 0
    for i, n in sums:
        if most is not None and total > most:
            break
        before[i], total = total, total + n
    if not before:
        return rows.limit(0).withColumn(name, F.lit(0).cast("long"))
    offsets = rows.sparkSession.createDataFrame(list(before.items()), f"`{at}` int, offset long")
    within = F.sum(own).over(W.partitionBy(at).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = sized.withColumn(name, within).join(F.broadcast(offsets), at).withColumn(name, (F.col(name) + F.col("offset")).cast("long"))  # one row a range
    return (out.where(F.col(name) <= most) if most is not None else out).drop(at, own, "offset")
