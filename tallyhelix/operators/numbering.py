"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhelix.session import written


def numbered(df: DataFrame, order: list[str], name: str = "place", first: int = 1) -> DataFrame:
    """The rows with their place in the order, from ``first`` on; rows that tie in all of ``order`` are in any order.

    Rows are dealt to ranges of the order and sorted there; a place is the number of rows in the ranges before plus the place in the own.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, because ranges are drawn anew each time they are asked for
    own = written(sorted_.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_own")), "numbered")
    sizes = {r["_range"]: r["n"] for r in own.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row per range
    before, rows = 0, []
    for k in sorted(sizes):
        rows.append((k, before))
        before += sizes[k]
    starts = df.sparkSession.createDataFrame(rows, "_range int, _start long")
    return own.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_start") + F.col("_own") + first).alias(name))
