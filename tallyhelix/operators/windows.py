"""Genomic windows: ranks of chromosomes, merging, pseudo-exons, distances.

Windows are rows (chrom, st, en, id). What runs along a chromosome runs within blocks of at most about ``BLOCK`` rows; what a block
takes over from those before comes from one row per block, so no task sees a whole chromosome.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tallyhelix.functions.scalar import bare_chrom
from tallyhelix.session import is_written, written

from .fragments import KIT
from .models import SORTED, quantiles
from .numbering import numbered

ORDER = ("st", "en", "id")
BEFORE = (Window.unboundedPreceding, -1)
#: Rows of a block, which a task sorts, with few others.
BLOCK = 250_000


def chrom_ranks(chroms: DataFrame) -> DataFrame:
    """(chrom, rank): numbers first, then X, Y, M, MT, then other names; from the chromosomes present."""
    c = chroms.select("chrom").distinct().withColumn("bare", bare_chrom(F.col("chrom")))
    number = F.when(F.col("bare").rlike(r"^\d+$"), F.col("bare").try_cast("long"))
    kind = F.when(number.isNotNull(), 0).otherwise(F.coalesce(*[F.when(F.col("bare") == x, i) for i, x in enumerate(("X", "Y", "M", "MT"), 1)], F.lit(5)))
    by = Window.orderBy("kind", "number", "bare", "chrom")  # one row per chromosome
    return c.withColumn("kind", kind).withColumn("number", number).select("chrom", F.dense_rank().over(by).alias("rank"))


def genome_sorted(windows: DataFrame) -> DataFrame:
    """Adds ``widx``: the place in genome order."""
    ranks = F.broadcast(chrom_ranks(windows))  # one row per chromosome
    return numbered(windows.join(ranks, "chrom"), ["rank", *ORDER], "widx", 0).drop("rank")


def blocks(windows: DataFrame) -> DataFrame:
    """The windows with ``_block``, which numbers ranges of starts on each chromosome, in that order; rows with one start stay together."""
    w = windows if is_written(windows) else written(windows, "windows")
    for shift in (16, 8, 0):
        bins = written(w.groupBy("chrom", F.shiftright("st", shift).alias("_bin")).agg(F.count("*").alias("_n")), "bins")
        size = bins.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most"), F.count("*").alias("bins")).first()
        if not size["rows"] or size["most"] <= BLOCK:
            break
    before = F.sum("_n").over(Window.partitionBy("chrom").orderBy("_bin").rowsBetween(*BEFORE))  # one row per bin
    of = bins.select("chrom", "_bin", F.floor(F.coalesce(before, F.lit(0)) / BLOCK).cast("int").alias("_block"))
    dealt = w.withColumn("_bin", F.shiftright("st", shift)).join(F.broadcast(of) if size["bins"] <= KIT else of, ["chrom", "_bin"])
    return dealt.select(*windows.columns, "_block").repartition(max(1, math.ceil((size["rows"] or 0) / BLOCK)), "chrom", "_block")


def _along() -> WindowSpec:
    return Window.partitionBy("chrom", "_block").orderBy(*ORDER)


def _running(blocked: DataFrame, of, value: Column, name: str, frame: tuple[int, int] = BEFORE) -> DataFrame:
    """Adds the running aggregate ``of`` (F.max or F.sum) of a value along each chromosome; null where the frame holds no value."""
    by = Window.partitionBy("chrom").orderBy("_block").rowsBetween(*BEFORE)  # one row per block
    carried = blocked.groupBy("chrom", "_block").agg(of(value).alias("_all")).select("chrom", "_block", of("_all").over(by).alias("_carried"))
    own = blocked.withColumn("_own", of(value).over(_along().rowsBetween(*frame))).join(F.broadcast(carried), ["chrom", "_block"])
    both = F.greatest("_own", "_carried") if of is F.max else F.coalesce(F.col("_own") + F.col("_carried"), "_own", "_carried")
    return own.withColumn(name, both).select(*blocked.columns, name)


def _with_running_end(windows: DataFrame) -> DataFrame:
    return _running(blocks(windows), F.max, F.col("en"), "prev_end")


def with_running_end(windows: DataFrame) -> DataFrame:
    """Adds ``prev_end``: the furthest end of the windows before on the chromosome."""
    return _with_running_end(windows).drop("_block")


def merged(windows: DataFrame) -> DataFrame:
    """Overlapping or touching windows become one; ids are joined by a dash."""
    first = F.when(F.col("prev_end") >= F.col("st"), 0).otherwise(1)
    isle = _running(_with_running_end(windows), F.sum, first, "isle", (Window.unboundedPreceding, Window.currentRow))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER))), lambda x: x["id"]), "-")
    return isle.groupBy("chrom", "isle").agg(F.min("st").alias("st"), F.max("en").alias("en"), ids.alias("id")).drop("isle")


def _distances(windows: DataFrame) -> DataFrame:
    return _with_running_end(windows).withColumn("ied", F.col("st") - F.col("prev_end") - 1)


def distances(windows: DataFrame) -> DataFrame:
    """(chrom, st, en, id, ied): gaps before windows, for pseudo-exons; null at the start of a chromosome."""
    return _distances(windows).drop("_block")


def spacing(windows: DataFrame, quantile: float = 0.8) -> DataFrame:
    """One row (median_len, selected_ied), truncated to whole numbers."""
    return _spacing(written(distances(windows).select("st", "en", "ied"), "distances"), quantile)


def _spacing(gaps: DataFrame, quantile: float = 0.8) -> DataFrame:
    """From written distances, as quantiles of many rows take several passes."""
    d = gaps.select((F.col("en") - F.col("st") + 1).alias("length"), F.when(F.col("ied") > 0, F.col("ied")).alias("ied"))
    return _floors(d, median_len=("length", 0.5), selected_ied=("ied", quantile))


def _floors(df: DataFrame, **asked: tuple[str, float]) -> DataFrame:
    """One row: quantiles of columns, truncated; null where a column has no values."""
    if df.count() <= SORTED:
        return df.agg(*[F.floor(F.percentile(c, q)).cast("long").alias(n) for n, (c, q) in asked.items()])
    got = [quantiles(df, c, [q]) for c, q in asked.values()]
    return df.sparkSession.createDataFrame([tuple(math.floor(v[0]) if v else None for v in got)], ", ".join(f"{n} long" for n in asked))


def longest_gaps(windows: DataFrame) -> DataFrame:
    return _longest(distances(windows))


def _longest(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("chrom").agg(F.greatest(F.coalesce(F.max("ied"), F.lit(0)), F.lit(0)).alias("longest_ied"))


def with_pseudo_exons(windows: DataFrame) -> DataFrame:
    """The windows and evenly spaced pseudo-exons in gaps that are long, but not the longest of the chromosome.

    Pseudo-exons are numbered through in genome order.
    """
    gaps = written(_distances(windows), "distances")
    ranks, size = F.broadcast(chrom_ranks(gaps)), F.broadcast(_spacing(gaps))  # one row per chromosome, and one row
    d = gaps.join(F.broadcast(_longest(gaps)), "chrom").join(ranks, "chrom").crossJoin(size)
    k = F.floor((F.col("ied") - F.col("selected_ied")) / (F.col("selected_ied") + F.col("median_len")))
    d = d.withColumn("k", F.when((F.col("ied") < F.col("longest_ied")) & (k > 0), k).otherwise(0).cast("long"))
    # only gaps that take pseudo-exons count, at their places
    d = _running(d.where("k > 0"), F.sum, F.col("k"), "before").withColumn("before", F.coalesce("before", F.lit(0)))
    per = d.groupBy("chrom", "rank").agg(F.sum("k").alias("n"))
    per = per.select("chrom", F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(*BEFORE)), F.lit(0)).alias("earlier"))
    gap = F.floor((F.col("ied") - F.col("k") * F.col("median_len")) / (F.col("k") + 1)).cast("long")
    new = d.join(F.broadcast(per), "chrom").withColumn("gap", gap).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    st = F.col("prev_end") + F.col("gap") + 1 + F.col("i") * (F.col("median_len") + F.col("gap"))
    new = new.select("chrom", st.alias("st"), (st + F.col("median_len") - 1).alias("en"), F.concat(F.lit("intergenic_"), (F.col("earlier") + F.col("before") + F.col("i") + 1).cast("string")).alias("id"))
    return windows.select("chrom", "st", "en", "id").unionByName(new)


def called_gaps(windows: DataFrame) -> DataFrame:
    """(chrom, widx, gap): distance to the exon before on the chromosome, of called exons."""
    lag = F.lag("en").over(Window.partitionBy("chrom").orderBy("widx"))
    return windows.withColumn("gap", F.col("st") - lag)


def gap_cutoffs(windows: DataFrame) -> DataFrame:
    """One row (max_ied, dmax): the median and the 0.9 quantile of gaps."""
    return _floors(called_gaps(windows).select("gap"), max_ied=("gap", 0.5), dmax=("gap", 0.9))
