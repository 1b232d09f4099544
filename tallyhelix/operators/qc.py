"""Quality control and the data behind plots: histograms, densities, fitted distributions, batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhelix.functions.scalar import half_normal_pdf, lognormal_pdf, normal_pdf


#: Fewest bins of a histogram, samples for one bin more, and points of a curve.
MIN_BINS, PER_BIN, POINTS = 20, 4, 1000


def histogram(cells: DataFrame) -> DataFrame:
    """(widx, bins, bin, n): counts in equal bins between the least and largest value of each exon, a bin for every four samples, at least 20."""
    span = cells.groupBy("widx").agg(F.min("fpm").alias("lo"), F.max("fpm").alias("hi"), F.greatest(F.lit(MIN_BINS), F.ceil(F.count("*") / PER_BIN)).cast("long").alias("bins")).where("hi > lo")
    at = F.least(F.floor((F.col("fpm") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1) + 1
    return cells.join(span, "widx").groupBy("widx", "bins", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def state_curves(cells: DataFrame, models: DataFrame, haploid: bool = False, points: int = POINTS) -> DataFrame:
    """(widx, i, x, p0..p3): densities of the four states of each exon that has a fit, on a grid from 0 to its largest value, rounded up."""
    top = cells.groupBy("widx").agg(F.ceil(F.max("fpm")).alias("top"))
    g = top.join(models.where("ecode not in (-1, -2)"), "widx").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    g = g.withColumn("x", F.col("top") * F.col("i") / float(points - 1))
    x, mu, sd = F.col("x"), F.col("mu"), F.col("sd")
    one = F.lit(0.0) if haploid else normal_pdf(x, mu / 2, sd / 2)
    return g.select("widx", "i", "x", half_normal_pdf(x, F.col("sd0")).alias("p0"), one.alias("p1"), normal_pdf(x, mu, sd).alias("p2"), lognormal_pdf(x, mu, sd, F.lit(haploid)).alias("p3"))


def call_quantiles(calls: DataFrame, samples: DataFrame, q: float = 0.8) -> DataFrame:
    """(cn, most): quantile over all samples of their numbers of calls; samples without calls count as 0."""
    states = calls.sparkSession.createDataFrame([(0,), (1,), (3,)], "cn int")
    n = calls.groupBy("s", "cn").agg(F.count("*").alias("n"))
    every = samples.select("s").crossJoin(states).join(n, ["s", "cn"], "left")
    return every.groupBy("cn").agg(F.percentile(F.coalesce("n", F.lit(0)), q).alias("most"))


def code_shares(models: DataFrame) -> DataFrame:
    """(ecode, n, pct): exons by code, those not captured left out."""
    n = models.where("ecode <> -1").groupBy("ecode").agg(F.count("*").alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("total")))  # one row
    return n.crossJoin(total).select("ecode", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def state_frequencies(states: DataFrame) -> DataFrame:
    """(cn, frequency, sd): a sample's mean number of exons in each state and its spread over samples, both as shares of all; states (s, state)."""
    four = states.sparkSession.range(4).select(F.col("id").cast("int").alias("cn"))
    n = states.groupBy("s", F.col("state").alias("cn")).agg(F.count("*").alias("n"))
    every = states.select("s").distinct().crossJoin(four).join(n, ["s", "cn"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = every.groupBy("cn").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    total = F.broadcast(per.agg(F.sum("mean").alias("total")))  # one row
    return per.crossJoin(total).select("cn", (F.col("mean") / F.col("total")).alias("frequency"), (F.col("sd") / F.col("total")).alias("sd"))


def batches_of_clusters(members: DataFrame, meta: DataFrame) -> DataFrame:
    """(cluster_id, n_batches, batches): batches of each cluster's samples as ``name:n``."""
    n = members.join(meta.select("sample", "batch"), "sample").groupBy("cluster_id", "batch").agg(F.count("*").alias("n"))
    item = F.struct("batch", F.concat_ws(":", "batch", F.col("n").cast("string")).alias("t"))
    return n.groupBy("cluster_id").agg(F.count("*").alias("n_batches"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",").alias("batches"))


#: Points of the grid on which bandwidths are found, and bins per point of a curve's grid at most; bandwidths beyond the largest searched count as none.
GRID, FINEST = 1024, 64
#: Derivatives that the bandwidth's equation starts from, and what the grid reaches beyond the values: a share of their range, or so much at least.
STAGES, BEYOND, LEAST_BEYOND = 7, 0.5, 6.0


def linear_bins(cells: DataFrame, by: list[str], at) -> DataFrame:
    """(by, b, k): each value counts for the two whole numbers around its place ``at``, the more the nearer."""
    low = F.floor(at)
    both = F.array(F.struct(low.alias("b"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("b"), (at - low).alias("w")))
    return cells.select(*by, F.explode(both).alias("q")).where("q.w > 0").groupBy(*by, "q.b").agg(F.sum("q.w").alias("k"))


def cosines(x: np.ndarray) -> np.ndarray:
    """The cosine transform: 2 * sum of x_n * cos(pi * k * (2 n + 1) / (2 N)), by one Fourier transform."""
    n = len(x)
    v = np.fft.fft(np.concatenate([x[::2], x[1::2][::-1]]))
    return 2 * (v * np.exp(-0.5j * np.pi * np.arange(n) / n)).real


def bandwidth(weights: np.ndarray, distinct: int) -> float | None:
    """Bandwidth, in lengths of the grid, by the improved rule of Sheather and Jones (Botev, Grotowski and Kroese 2010) from binned values.

    The squared bandwidth t is the least fixed point of t = xi * gamma(t): from the norm of a high derivative of the density, smoothed by t, follows the
    best smoothing for the norm of the next lower one, down to the second, and from that the best t. None if there is no such point up to 0.1.
    """
    a = cosines(weights / weights.sum())[1:]
    squares, power = a * a, np.arange(1, len(weights), dtype=float) ** 2

    def norm(s: int, t: float) -> float:
        return 0.5 * np.pi ** (2 * s) * float((power**s * squares * np.exp(-power * np.pi**2 * t)).sum())

    def off(t: float) -> float:
        f = norm(STAGES, t)
        for s in range(STAGES - 1, 1, -1):
            odd = float(np.prod(np.arange(1, 2 * s, 2))) / math.sqrt(2 * math.pi)
            f = norm(s, (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / (distinct * f)) ** (2 / (3 + 2 * s)))
        return t - (2 * distinct * math.sqrt(math.pi) * f) ** -0.4

    with np.errstate(all="ignore"):
        try:
            low, high = 0.0, 1e-12
            while not off(high) > 0:
                low, high = high, 2 * high
                if high > 0.1:
                    return None
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (mid, high) if not off(mid) > 0 else (low, mid)
        except (ZeroDivisionError, OverflowError):
            return None
    return math.sqrt(high)


def bandwidths(cells: DataFrame, upper: float) -> DataFrame:
    """(s, top, total, h): a quantile, number and bandwidth of each sample's values; samples without spread or bandwidth are left out."""
    per = cells.groupBy("s").agg(F.percentile("fpm", upper).alias("top"), F.min("fpm").alias("lo"), F.max("fpm").alias("hi"), F.count("*").alias("total"), F.count_distinct("fpm").alias("kinds"))
    margin = F.greatest(BEYOND * (F.col("hi") - F.col("lo")), F.lit(LEAST_BEYOND))
    per = per.where("top > 0 and hi > lo").withColumn("from", F.col("lo") - margin).withColumn("span", F.col("hi") - F.col("lo") + 2 * margin)
    by = ["s", "top", "total", "kinds", "span"]
    bins = linear_bins(cells.join(per, "s"), by, (F.col("fpm") - F.col("from")) / F.col("span") * (GRID - 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # at most GRID rows of a sample
        w = np.zeros(GRID + 1)
        np.add.at(w, pdf.b.to_numpy(), pdf.k.to_numpy())
        h = bandwidth(w[:GRID], int(pdf.kinds.iloc[0]))
        return pdf.iloc[:1].assign(h=None if h is None else h * pdf["span"].iloc[0])[["s", "top", "total", "h"]]

    kind = cells.schema["s"].dataType.simpleString()
    return bins.groupBy("s").applyInPandas(run, f"s {kind}, top double, total long, h double").where("h > 0")


def density(cells: DataFrame, points: int, upper: float = 0.96) -> DataFrame:
    """(s, i, x, y): Gaussian kernel density of each sample's values, mirrored at 0, on a grid up to a quantile.

    Bandwidths are those of ``bandwidth``, over all values. Values up to three bandwidths beyond the quantile enter the curve, as bins on a grid of an eighth of the
    bandwidth where that takes at most ``FINEST`` bins a point; the sum of kernels is a product of Fourier transforms.
    """
    per = bandwidths(cells, upper).withColumn("step", F.col("top") / (points - 1))
    per = per.withColumn("finer", F.least(F.greatest(F.ceil(8 * F.col("step") / F.col("h")), F.lit(1)), F.lit(FINEST)).cast("long"))
    near = cells.join(per, "s").where("fpm <= top + 3 * h")
    bins = linear_bins(near, ["s", "h", "step", "finer"], F.col("fpm") / (F.col("step") / F.col("finer")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # at most a row per bin of a sample's grid
        h, step, finer = float(pdf.h.iloc[0]), float(pdf.step.iloc[0]), int(pdf.finer.iloc[0])
        fine, half = step / finer, int(pdf.b.max()) + 1
        reach = half + (points - 1) * finer + 1
        n = 1 << int(np.ceil(np.log2(2 * reach + 2)))  # no wrapping within the kernels' reach
        w = np.zeros(n)
        b, k = pdf.b.to_numpy(), pdf.k.to_numpy()
        np.add.at(w, b, k)
        np.add.at(w, -b % n, k)  # mirrored
        far = np.minimum(np.arange(n), n - np.arange(n)) * fine / h
        kernel = np.exp(-0.5 * far * far) / (h * math.sqrt(2 * math.pi))
        y = np.fft.irfft(np.fft.rfft(w) * np.fft.rfft(kernel), n)[: (points - 1) * finer + 1 : finer] / k.sum()
        return pd.DataFrame({"s": pdf.s.iloc[0], "i": np.arange(points), "x": np.arange(points) * step, "y": np.maximum(y, 0)})

    kind = cells.schema["s"].dataType.simpleString()
    return bins.groupBy("s").applyInPandas(run, f"s {kind}, i int, x double, y double")


def _first_extreme(y, start, window: int, low: bool):
    """struct(at, v, seen, done): the first value from ``start`` on that the next ``window`` - 1 unequal ones do not pass."""
    state = lambda at, v, seen, done: F.struct(at.alias("at"), v.alias("v"), seen.alias("seen"), done.alias("done"))

    def step(s, q):
        beyond = q["y"] < s["v"] if low else q["y"] > s["v"]
        seen = s["seen"] + F.when(q["y"] == s["v"], 0).otherwise(1)
        return F.when(s["done"] | (q["i"] <= start["i"]), s).when(beyond, state(q["i"], q["y"], F.lit(1), F.lit(False))).otherwise(state(s["at"], s["v"], seen, seen >= window))

    return F.aggregate(y, state(start["i"], start["y"], F.lit(1), F.lit(window <= 1)), step)


def first_low_and_high(curve: DataFrame, window: int = 20) -> DataFrame:
    """(s, low_x, high_x, ok): the first low of each curve, the first high after it, and whether they differ by a fifth of the low.

    A low is confirmed by ``window`` - 1 larger values before any smaller one, equal values not counted; a high likewise. What is not confirmed is null.
    """
    per = curve.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("c"))
    low = per.withColumn("low", _first_extreme(F.col("c"), F.col("c")[0], window, True))
    low = low.withColumn("from", F.get(F.filter("c", lambda q: F.col("low.done") & (q["i"] == F.col("low.at"))), F.lit(0)))
    both = low.withColumn("high", F.when(F.col("low.done"), _first_extreme(F.col("c"), F.col("from"), window, False)))
    at = lambda name: F.get(F.filter("c", lambda q: F.col(f"{name}.done") & (q["i"] == F.col(f"{name}.at"))), F.lit(0))["x"]
    ok = F.when(F.col("high.done"), F.try_divide(F.col("high.v") - F.col("low.v"), F.col("low.v")) >= 0.2)
    return both.select("s", F.round(at("low"), 3).alias("low_x"), F.round(at("high"), 3).alias("high_x"), F.coalesce(ok, F.lit(False)).alias("ok"))


#: Bins of the histogram that fits are judged by, and bins of each of them that likelihoods are taken over.
JUDGED, WITHIN = 100, 40


def _lg(x: float) -> float:
    return math.lgamma(x)


def _on(x: np.ndarray, inside, value) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(inside, value, -np.inf)


#: Log-densities, by their parameters; a name's letters: p positive, r any number. Starting values come from mean m, spread d, median q, mean and spread of logarithms l, e, and largest value t.
FAMILIES = {
    "normal": ("rp", lambda x, u, s: -0.5 * ((x - u) / s) ** 2 - math.log(s * math.sqrt(2 * math.pi)), lambda m, d, q, l, e, t: (m, d)),
    "halfnormal": ("p", lambda x, s: _on(x, x >= 0, -0.5 * (x / s) ** 2 + math.log(2 / (s * math.sqrt(2 * math.pi)))), lambda m, d, q, l, e, t: (math.hypot(m, d),)),
    "lognormal": ("rp", lambda x, u, s: _on(x, x > 0, -0.5 * ((np.log(x) - u) / s) ** 2 - np.log(x * s * math.sqrt(2 * math.pi))), lambda m, d, q, l, e, t: (l, e)),
    "exponential": ("p", lambda x, s: _on(x, x >= 0, -x / s - math.log(s)), lambda m, d, q, l, e, t: (abs(m) or 1,)),
    "gamma": ("pp", lambda x, a, s: _on(x, x > 0, (a - 1) * np.log(x) - x / s - _lg(a) - a * math.log(s)), lambda m, d, q, l, e, t: ((m / d) ** 2, d * d / abs(m or 1))),
    "weibull": ("pp", lambda x, a, s: _on(x, x > 0, math.log(a / s) + (a - 1) * np.log(x / s) - (x / s) ** a), lambda m, d, q, l, e, t: (1.2 / e, math.exp(l + 0.48 * e))),
    "beta": ("ppp", lambda x, a, b, s: _on(x, (x > 0) & (x < s), (a - 1) * np.log(x / s) + (b - 1) * np.log1p(-x / s) + _lg(a + b) - _lg(a) - _lg(b) - math.log(s)), lambda m, d, q, l, e, t: (1.5, 1.5, 1.05 * t)),
    "student": ("prp", lambda x, n, u, s: _lg((n + 1) / 2) - _lg(n / 2) - 0.5 * math.log(n * math.pi) - math.log(s) - (n + 1) / 2 * np.log1p(((x - u) / s) ** 2 / n), lambda m, d, q, l, e, t: (5.0, q, 0.8 * d)),
    "generalised normal": ("prp", lambda x, b, u, s: math.log(b / (2 * s)) - _lg(1 / b) - (np.abs(x - u) / s) ** b, lambda m, d, q, l, e, t: (1.6, q, 1.2 * d)),
    "logistic": ("rp", lambda x, u, s: -(np.abs(x - u) / s) - 2 * np.log1p(np.exp(-np.abs(x - u) / s)) - math.log(s), lambda m, d, q, l, e, t: (m, 0.55 * d)),
    "gumbel": ("rp", lambda x, u, s: -(x - u) / s - np.exp(np.minimum(-(x - u) / s, 700)) - math.log(s), lambda m, d, q, l, e, t: (m - 0.45 * d, 0.78 * d)),
    "laplace": ("rp", lambda x, u, s: -np.abs(x - u) / s - math.log(2 * s), lambda m, d, q, l, e, t: (q, 0.7 * d)),
    "cauchy": ("rp", lambda x, u, s: -np.log1p(((x - u) / s) ** 2) - math.log(math.pi * s), lambda m, d, q, l, e, t: (q, 0.5 * d)),
    "rayleigh": ("p", lambda x, s: _on(x, x > 0, np.log(x / (s * s)) - 0.5 * (x / s) ** 2), lambda m, d, q, l, e, t: (math.hypot(m, d) / math.sqrt(2),)),
    "inverse normal": ("pp", lambda x, u, k: _on(x, x > 0, 0.5 * np.log(k / (2 * math.pi * x**3)) - k * (x - u) ** 2 / (2 * u * u * x)), lambda m, d, q, l, e, t: (abs(m) or 1, abs(m**3) / (d * d) or 1)),
}


def simplex(f, start: list[float], rounds: int = 2_000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """(place, value) of a minimum by the downhill simplex; f may be infinite."""
    points = [np.array(start, float)]
    for k in range(len(start)):
        p = points[0].copy()
        p[k] += 0.1 * max(abs(p[k]), 1.0)
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = sorted(range(len(points)), key=values.__getitem__)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if not values[-1] - values[0] > tolerance * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], 0)
        away = lambda by: centre + by * (centre - points[-1])  # noqa: E731, B023
        near = away(1.0)
        v = f(near)
        if v < values[0]:
            further = away(2.0)
            w = f(further)
            near, v = (further, w) if w < v else (near, v)
        elif v >= values[-2]:
            between = away(0.5) if v < values[-1] else away(-0.5)
            near, v = between, f(between)
            if v >= values[-1]:
                points = [points[0], *[(p + points[0]) / 2 for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
                continue
        points[-1], values[-1] = near, v
    best = min(range(len(points)), key=values.__getitem__)
    return points[best], values[best]


def fitted_family(name: str, x: np.ndarray, n: np.ndarray, moments: tuple) -> tuple[list[float], np.ndarray] | None:
    """(parameters, log-densities at x) of the greatest likelihood of n values at each x; None where the family can't hold the values."""
    kinds, log_density, start = FAMILIES[name]
    total = n.sum()

    def given(p):
        return [math.exp(min(v, 300.0)) if k == "p" else v for k, v in zip(kinds, p, strict=True)]

    def loss(p) -> float:
        try:
            with np.errstate(all="ignore"):
                v = float(-(n * np.where(n > 0, log_density(x, *given(p)), 0.0)).sum() / total)
        except (ValueError, OverflowError, ZeroDivisionError):
            return math.inf
        return v if v == v else math.inf

    try:
        first = [math.log(v) if k == "p" else v for k, v in zip(kinds, start(*moments), strict=True)]
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    p, v = simplex(loss, first)
    if not math.isfinite(v):
        return None
    with np.errstate(all="ignore"):
        return given(p), log_density(x, *given(p))


def fitted_distributions(cells: DataFrame, bins: int = JUDGED) -> DataFrame:
    """(name, a, b, c, sse): each family of up to three parameters fitted by its likelihood, and its squared distance from the density histogram, best first.

    Values enter as ``bins`` times ``WITHIN`` equal bins between the least and the largest; a family is one row from then on. Families that can't hold the values, and values without a spread, give no row.
    """
    v = cells.select("fpm").where(F.col("fpm").isNotNull())
    logs = F.log(F.when(F.col("fpm") > 0, F.col("fpm")))
    m = v.agg(F.min("fpm").alias("lo"), F.max("fpm").alias("hi"), F.avg("fpm").alias("m"), F.stddev_pop("fpm").alias("d"), F.avg(logs).alias("l"), F.stddev_pop(logs).alias("e"))
    m = m.where("hi > lo").withColumn("width", (F.col("hi") - F.col("lo")) / (bins * WITHIN))  # one row
    at = F.least(F.floor((F.col("fpm") - F.col("lo")) / F.col("width")), F.lit(bins * WITHIN - 1)).cast("long")
    fine = v.crossJoin(F.broadcast(m)).groupBy(at.alias("b")).agg(F.count("*").alias("n"))
    whole = fine.agg(F.collect_list(F.struct("b", "n")).alias("bins")).crossJoin(F.broadcast(m))  # at most bins * WITHIN pairs
    names = v.sparkSession.createDataFrame([(n,) for n in FAMILIES], "name string")

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                n = np.zeros(bins * WITHIN)
                for q in r.bins:
                    n[q["b"]] = q["n"]
                x = r.lo + (np.arange(len(n)) + 0.5) * r.width
                middle = float(x[np.searchsorted(np.cumsum(n), n.sum() / 2)])
                got = fitted_family(r.name, x, n, (r.m, r.d, middle, r.l, max(r.e, 1e-6), r.hi))
                if got is None:
                    continue
                mine, y = np.exp(got[1][WITHIN // 2 :: WITHIN]), n.reshape(bins, WITHIN).sum(1) / (n.sum() * r.width * WITHIN)
                a, b, c = [*got[0], None, None][:3]
                yield pd.DataFrame({"name": [r.name], "a": [a], "b": [b], "c": [c], "sse": [float(((mine - y) ** 2).sum())]})

    rows = names.repartition(len(FAMILIES)).crossJoin(F.broadcast(whole)).mapInPandas(run, "name string, a double, b double, c double, sse double")
    return rows.where(~F.isnan("sse")).select("name", *[F.round(p, 3).alias(p) for p in "abc"], F.round(F.col("sse") * 1e9, 6).alias("sse")).orderBy("sse", "name")
