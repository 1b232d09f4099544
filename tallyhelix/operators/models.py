"""Normalised counts, copy-number models per window, likelihoods.

Cells are long rows (s, widx, ...), one per sample and window; models are one row per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhelix.functions.scalar import HALF_NORMAL_95, TRUNCATED_SD_2, argmax, half_normal_pdf, let, lognormal_pdf, normal_pdf

MIN_Z, MIN_SUPPORT = 2.0, 0.5
EPS, MAX_STEPS = 1e-5, 200


def fpm(cells: DataFrame) -> DataFrame:
    """Adds fragments per million: of autosome exons on their own sum, all others on the whole sum."""
    total = cells.groupBy("s").agg(F.sum(F.when(F.col("wtype") == 0, F.col("n")).otherwise(0)).alias("auto_sum"), F.sum("n").alias("all_sum"))
    base = F.when(F.col("wtype") == 0, F.col("auto_sum")).otherwise(F.col("all_sum"))
    return cells.join(total, "s").withColumn("fpm", F.col("n") * 1e6 / F.when(base == 0, 1).otherwise(base)).drop("auto_sum", "all_sum")


def cn0(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(sd0, fpm_cn0), one row or one per ``by``: half-normal of the intergenic windows, and its 95% point."""
    one = cells.where("wtype = 2").groupBy(*by).agg(F.sqrt(F.avg(F.col("fpm") * F.col("fpm"))).alias("sd"), F.count("*").alias("n"))
    sd = F.col("sd") + F.col("sd") / (4 * F.col("n"))
    return one.select(*by, sd.alias("sd0"), (sd * HALF_NORMAL_95).alias("fpm_cn0"))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def _sd(x: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(x))


def robust_fit(x: Column) -> Column:
    """struct(mu, sd, ok): mean and sd of the bulk of a sorted array, by repeated cuts at two sd.

    Starts at the median and a third of the sd; fails where the median or the mean found is 0, where a cut keeps nothing, or
    where ``MAX_STEPS`` cuts do not settle. A bulk of equal values that has settled gets 5% of its mean as sd.
    """
    n = F.size(x)
    median = (F.element_at(x, F.floor((n + 1) / 2).cast("int")) + F.element_at(x, F.floor(n / 2 + 1).cast("int"))) / 2
    state = lambda mu, sd, ok, done: F.struct(mu.alias("mu"), sd.alias("sd"), ok.alias("ok"), done.alias("done"))
    start = let(_mean(x), lambda mean: state(median, _sd(x, mean) / 3, F.lit(False), median <= 0))

    def refit(s, kept):
        def of_mean(mean):
            return let(_sd(kept, mean) / TRUNCATED_SD_2, lambda sd: let(F.abs(mean - s["mu"]) + F.abs(sd - s["sd"]) <= EPS, lambda settled: state(mean, sd, settled & (mean != 0), settled)))

        return F.when(F.size(kept) == 0, state(s["mu"], s["sd"], F.lit(False), F.lit(True))).otherwise(let(_mean(kept), of_mean))

    def step(s, _):
        kept = F.filter(x, lambda v: F.abs(v - s["mu"]) < 2 * s["sd"])
        return F.when(s["done"], s).otherwise(let(kept, lambda k: refit(s, k)))

    width = lambda s: F.when(s["ok"] & (s["sd"] == 0), s["mu"] * 0.05).otherwise(s["sd"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEPS)), start, step, lambda s: F.struct(s["mu"].alias("mu"), width(s).alias("sd"), s["ok"].alias("ok")))


def fitted(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, widx, median, mu, sd, ok, x) of each exon; one row holds the values of one exon over the samples."""
    per = cells.groupBy(*by, "widx").agg(F.array_sort(F.collect_list("fpm")).alias("x"), F.percentile("fpm", 0.5).alias("median"))
    return per.withColumn("fit", robust_fit(F.col("x"))).select(*by, "widx", "median", "fit.mu", "fit.sd", "fit.ok", "x")


def ecodes(fits: DataFrame, zero: DataFrame, by: tuple[str, ...] = (), haploid: Column | bool = False) -> DataFrame:
    """(*by, widx, ecode, mu, sd): -1 not captured, -2 no fit, -3 little support, -4 too near to CN0, 1 CN1 too near (of diploids), 0 called."""
    zero = F.broadcast(zero)  # one row, or one per cluster
    d = fits.join(zero, list(by)) if by else fits.crossJoin(zero)
    haploid = F.lit(haploid) if isinstance(haploid, bool) else haploid
    near = F.size(F.filter("x", lambda v: F.abs(v - F.col("mu")) < 2 * F.col("sd")))
    code = (
        F.when(F.col("median") <= F.col("fpm_cn0"), -1)
        .when(~F.col("ok"), -2)
        .when(near < MIN_SUPPORT * F.size("x"), -3)
        .when(F.col("mu") - MIN_Z * F.col("sd") <= F.col("fpm_cn0"), -4)
        .when(~haploid & (F.col("mu") / 2 - MIN_Z * F.col("sd") / 2 <= F.col("fpm_cn0")), 1)
        .otherwise(0)
    )
    return d.withColumn("ecode", code).withColumn("support", near).select(*by, "widx", "ecode", "median", "mu", "sd", "support", "sd0", "fpm_cn0")


def likelihoods(cells: DataFrame, models: DataFrame, haploid: Column | bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, s, widx, fpm, mu, l0..l3) of called exons; haploids have no state of one copy."""
    haploid = F.lit(haploid) if isinstance(haploid, bool) else haploid
    d = cells.join(models.where("ecode >= 0").select(*by, "widx", "ecode", "mu", "sd", "sd0"), [*by, "widx"])
    x, mu, sd = F.col("fpm"), F.col("mu"), F.col("sd")
    l1 = F.when(haploid | (F.col("ecode") == 1), 0.0).otherwise(normal_pdf(x, mu / 2, sd / 2))
    return d.select(*by, "s", "widx", "fpm", "mu", half_normal_pdf(x, F.col("sd0")).alias("l0"), l1.alias("l1"), normal_pdf(x, mu, sd).alias("l2"), lognormal_pdf(x, mu, sd, haploid).alias("l3"))


def best_state(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    return argmax(*[F.col(f"l{i}") * p for i, p in enumerate((p0, p1, p2, p3))])


#: Values that one task sorts; more are first narrowed down, by so many bins at a time.
SORTED, BINS = 1_000_000, 1024


def _at_rank(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of a 0-based rank: the bin that holds it is cut into bins again, until one task can sort what is left."""
    while True:
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low or inside.count() <= SORTED:
            return inside.agg(F.element_at(F.sort_array(F.collect_list("v")), rank + 1)).first()[0] if width > 0 else low
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        before = 0
        for r in sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["bin"]):  # at most BINS rows
            if rank < before + r["n"]:
                rank, low, high = rank - before, r["lo"], r["hi"]
                break
            before += r["n"]


def quantiles(cells: DataFrame, column: str, qs: list[float]) -> list[float] | None:
    """Exact quantiles, between two values by linear interpolation; none of an empty table."""
    values = cells.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    if n <= SORTED:
        return list(values.agg(F.percentile("v", qs)).first()[0])
    out = []
    for q in qs:
        place = q * (n - 1)
        rank = int(place)
        a = _at_rank(values, rank, low, high)
        b = _at_rank(values, rank + 1, low, high) if place > rank else a
        out.append(a + (b - a) * (place - rank))
    return out


def typed_quantiles(cells: DataFrame, qs: list[float]) -> DataFrame:
    """(wtype, q<percent>...): quantiles of the values of each type of window."""
    rows = [(t, *got) for t in (0, 1, 2) if (got := quantiles(cells.where(F.col("wtype") == t), "fpm", qs))]
    return cells.sparkSession.createDataFrame(rows, "wtype int, " + ", ".join(f"q{int(q * 100)} double" for q in qs))


def captured(cells: DataFrame) -> DataFrame:
    """Exons of X and Z whose 20% quantile exceeds the 99% quantile of all intergenic cells."""
    limit = quantiles(cells.where("wtype = 2"), "fpm", [0.99])
    per = cells.where("wtype = 1").groupBy("widx", "chrom").agg(F.percentile("fpm", 0.2).alias("q20"))  # one value per sample
    return per.where(F.col("q20") > F.lit(limit[0] if limit else float("inf")))
