"""Joins on ranges as joins on keys: bins of several widths, so that a range of any length lies in one bin or two.

The width of a bin doubles ``STEP`` times from level to level. A range takes the level whose bins are at least as long as itself; what it may
meet is put into the bins of every level that some range takes, which is at most ``len(LEVELS)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two of the widths, from 512 bases to a billion; longer ranges take the last.
STEP = 3
LEVELS = tuple(range(9, 31, STEP))


def level(s: Column, e: Column) -> Column:
    """The level of the range from s to e, both included."""
    out = F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        out = F.when(e - s < (1 << k), F.lit(k)).otherwise(out)
    return out


def bin_at(x: Column, at: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), at)).cast("long")


def bins(s: Column, e: Column, at: Column) -> Column:
    """The bins that the range meets at a level, as an array."""
    return F.sequence(bin_at(s, at), bin_at(e, at))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], l: tuple[str, str], r: tuple[str, str]) -> DataFrame:  # noqa: E741
    """Rows of both sides whose ranges share a base, ends included, with equal ``on``; each pair once. Columns must differ but for ``on``.

    Ranges of the right side, such as windows, should be short: each is put into its bins at every level that the left side has.
    """
    a = left.where(F.col(l[0]) <= F.col(l[1])).withColumn("_level", level(F.col(l[0]), F.col(l[1])))
    used = F.broadcast(a.select("_level").distinct())  # a row per level
    a = a.withColumn("_first", bin_at(F.col(l[0]), F.col("_level"))).withColumn("_bin", F.explode(bins(F.col(l[0]), F.col(l[1]), F.col("_level"))))
    b = right.where(F.col(r[0]) <= F.col(r[1])).crossJoin(used).withColumn("_own", bin_at(F.col(r[0]), F.col("_level")))
    b = b.withColumn("_bin", F.explode(bins(F.col(r[0]), F.col(r[1]), F.col("_level"))))
    # a pair that shares several bins counts in the first of them
    meet = (F.col(r[0]) <= F.col(l[1])) & (F.col(l[0]) <= F.col(r[1])) & (F.col("_bin") == F.greatest("_first", "_own"))
    return a.join(b, [*on, "_level", "_bin"]).where(meet).drop("_level", "_bin", "_first", "_own")


def containing(ranges: DataFrame, points: DataFrame, on: list[str], one: tuple[str, str], two: tuple[str, str], at: tuple[str, str]) -> DataFrame:
    """Rows of both sides where the first place lies in the first range and the second in the second, ends included, with equal ``on``.

    The key is a bin of each coordinate. Columns must differ but for ``on``.
    """
    a = ranges.where((F.col(one[0]) <= F.col(one[1])) & (F.col(two[0]) <= F.col(two[1])))
    a = a.withColumn("_l1", level(*map(F.col, one))).withColumn("_l2", level(*map(F.col, two)))
    used = F.broadcast(a.select("_l1", "_l2").distinct())  # at most a row per two levels
    a = a.withColumn("_b1", F.explode(bins(F.col(one[0]), F.col(one[1]), F.col("_l1")))).withColumn("_b2", F.explode(bins(F.col(two[0]), F.col(two[1]), F.col("_l2"))))
    b = points.crossJoin(used).withColumn("_b1", bin_at(F.col(at[0]), F.col("_l1"))).withColumn("_b2", bin_at(F.col(at[1]), F.col("_l2")))
    inside = F.col(at[0]).between(F.col(one[0]), F.col(one[1])) & F.col(at[1]).between(F.col(two[0]), F.col(two[1]))
    return a.join(b, [*on, "_l1", "_b1", "_l2", "_b2"]).where(inside).drop("_l1", "_b1", "_l2", "_b2")
