"""Priors, transitions and decoding of copy-number states.

Counts are aggregates over all cells; the iteration for priors carries four numbers. Decoding runs per
(cluster, sample, chromosome), whose exons are a bounded list, in log space.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .models import best_state

MAX_ROUNDS = 20
POWER = 5
MAX_SCORE = 100.0
#: Where a product of doubles becomes zero.
UNDERFLOW = -323.3


def state_counts(lik: DataFrame, priors=(1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """(cn, n): cells by most likely state, one added to each."""
    p = [F.lit(float(x)) for x in priors]
    n = lik.select(best_state(*p).alias("cn")).groupBy("cn").count()
    four = lik.sparkSession.createDataFrame([(i,) for i in range(4)], "cn int")
    return four.join(F.broadcast(n), "cn", "left").select("cn", (F.coalesce("count", F.lit(0)) + 1).alias("n"))


def priors(lik: DataFrame) -> tuple[list[float], int]:
    """Shares of states, iterated until they repeat to three digits; and the rounds it took."""
    lik = lik.select("l0", "l1", "l2", "l3").persist()
    try:
        now, seen = [1.0] * 4, None
        for rounds in range(1, MAX_ROUNDS + 1):
            n = {r["cn"]: r["n"] for r in state_counts(lik, now).collect()}  # four numbers
            total = sum(n.values())
            now = [n[i] / total for i in range(4)]
            text = [f"{p:.2e}" for p in now]
            if text == seen:
                break
            seen = text
        return now, rounds
    finally:
        lik.unpersist()


def transitions(lik: DataFrame, windows: DataFrame, p: list[float], max_ied: int) -> DataFrame:
    """(prev, cur, n, p): moves between called exons that lie close, one added to each, as shares of a row."""
    d = lik.withColumn("state", best_state(*map(F.lit, p))).join(windows.select("widx", "chrom", "st", "en"), "widx")
    by = Window.partitionBy("s", "chrom").orderBy("widx")
    d = d.select(F.lag("state").over(by).alias("prev"), F.col("state").alias("cur"), (F.col("st") - F.lag("en").over(by)).alias("gap"))
    n = d.where(F.col("gap") <= max_ied).groupBy("prev", "cur").count()
    all16 = lik.sparkSession.createDataFrame([(i, j) for i in range(4) for j in range(4)], "prev int, cur int")
    m = all16.join(F.broadcast(n), ["prev", "cur"], "left").select("prev", "cur", (F.coalesce("count", F.lit(0)) + 1).alias("n"))
    return m.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def adjusted(t, p, d, dmax):
    """Transition probability at distance d: fades into the prior."""
    return F.when(d >= dmax, p).otherwise(t + (p - t) * F.pow(d / dmax, F.lit(POWER)))


def runs(states: DataFrame) -> DataFrame:
    """(s, cn, first_w, last_w, n): runs of equal states other than 2 along each chromosome."""
    by = Window.partitionBy("s", "chrom").orderBy("widx")
    change = F.when(F.lag("state").over(by) == F.col("state"), 0).otherwise(1)
    isle = states.withColumn("_c", change).withColumn("_isle", F.sum("_c").over(by))
    return isle.where("state <> 2").groupBy("s", "chrom", "_isle", "state").agg(F.min("widx").alias("first_w"), F.max("widx").alias("last_w"), F.count("*").alias("n")).select("s", F.col("state").alias("cn"), "first_w", "last_w", "n")


def _forward(st, en, lik, trans, prior, dmax):
    """Best paths into every exon, of all samples together: (previous states, log paths, log CN2 steps, where paths start anew, where they died)."""
    n, samples = lik.shape[1], lik.shape[0]
    best, now = np.zeros((n, samples, 4), np.int8), np.zeros((n, samples, 4))
    steps, fresh, dead = np.zeros((n, samples)), np.zeros((n, samples), bool), np.zeros((n, samples), bool)
    prev = np.tile([-np.inf, -np.inf, 0.0, -np.inf], (samples, 1))
    for k in range(n):
        d = dmax if k == 0 else st[k] - en[k - 1] - 1
        a = np.tile(prior, (4, 1)) if d >= dmax else trans + (prior[None, :] - trans) * (d / dmax) ** POWER
        with np.errstate(divide="ignore"):
            a = np.log10(a)
        p = prev[:, :, None] + a[None] + lik[:, k, None, :]
        top = p.max(1)
        none = np.isneginf(top)
        dead[k] = none.all(1)
        best[k] = np.where(none, 2, p.argmax(1))
        fresh[k] = (best[k] == 2).all(1)
        now[k] = np.where(fresh[k][:, None], a[2] + lik[:, k], top)
        steps[k] = a[2, 2] + lik[:, k, 2]
        prev = now[k]
    return best, now, steps, fresh, dead


def _emit(widx, best, now, steps, closing: bool, min_gq: float) -> list:
    """CNVs of one stretch between two places where the paths start anew."""
    best, now, steps = list(best), list(now), list(steps)
    if closing and int(np.argmax(now[-1])) != 2:
        last = now[-1]
        best.append(np.full(4, int(np.argmax(last))))
        now.append(np.full(4, last.max()))
        steps.append(0.0)
    if all(b[2] == 2 for b in best):
        return []
    states, out, first = [2], [], 0
    for b in reversed(best[1:]):
        states.append(int(b[states[-1]]))
    states = states[::-1]
    for i in range(1, len(best)):
        if states[i] == states[first]:
            continue
        if states[first] != 2:
            cost, score = sum(steps[first : i + 1]), MAX_SCORE
            if cost > UNDERFLOW:
                score = min(now[i][states[i]] - cost - (now[first - 1][states[first - 1]] if first else 0.0), MAX_SCORE)
            if score >= min_gq:
                out.append((states[first], widx[first], widx[i - 1], float(score)))
        first = i
    return out


def decode_many(widx, st, en, lik, trans, prior, dmax, min_gq):
    """(sample number, cn, first, last, score) along one chromosome from likelihoods (samples x exons x 4).

    When every best path into an exon comes from CN2, what lies before is settled: it is emitted and
    the path starts anew. A run's score is the log10 ratio of its path to the all-CN2 path. Exons are taken one after the other, all samples at once; only
    stretches that leave CN2 are traced back.
    """
    n = len(widx)
    if not n:
        return []
    with np.errstate(divide="ignore"):
        trans, prior, lik = np.asarray(trans, float), np.asarray(prior, float), np.log10(np.asarray(lik, float))
    best, now, steps, fresh, dead = _forward(st, en, lik, trans, prior, dmax)
    out = []
    for s in range(lik.shape[0]):
        starts = np.flatnonzero(fresh[:, s])
        if not len(starts) or starts[0]:
            starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], n)
        closing = np.append(dead[starts[1:], s], True)
        away = np.concatenate([[0], np.cumsum(best[:, s, 2] != 2)])
        leaves = (away[ends] > away[starts]) | (closing & (now[ends - 1, s].argmax(1) != 2))
        for a, z, c in zip(starts[leaves].tolist(), ends[leaves].tolist(), closing[leaves].tolist(), strict=True):
            out += [(s, *x) for x in _emit(widx[a:z], best[a:z, s], now[a:z, s], steps[a:z, s].tolist(), c, min_gq)]
    return out


def decode(widx, st, en, lik, trans, prior, dmax, min_gq):
    """CNVs (cn, first, last, score) of one sample, from likelihoods (exons x 4)."""
    lik = np.asarray(lik, float).reshape(1, -1, 4)
    return [x[1:] for x in decode_many(widx, st, en, lik, trans, prior, dmax, min_gq)]


#: Samples that one group decodes together.
TOGETHER = 64


def viterbi(lik: DataFrame, windows: DataFrame, models: dict, min_gq: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, s, cn, first_w, last_w, qs); models: cluster -> (transitions, priors, dmax), under None where there are no clusters.

    One group holds a chromosome of at most about ``TOGETHER`` samples of a cluster.
    """
    d = lik.join(windows.select("widx", "chrom", "st", "en"), "widx").select(*by, "s", "chrom", "widx", "st", "en", "l0", "l1", "l2", "l3")
    parts = max(1, -(-lik.select("s").distinct().count() // TOGETHER))
    d = d.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(parts)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "widx"])
        key = [pdf[c].iloc[0] for c in by]
        ids, n = pdf.s.unique(), pdf.widx.nunique()
        w = pdf.iloc[:n]  # all samples of a cluster have the same exons
        got = decode_many(w.widx.tolist(), w.st.tolist(), w.en.tolist(), pdf[["l0", "l1", "l2", "l3"]].to_numpy().reshape(len(ids), n, 4), *models[key[0] if key else None], min_gq)
        return pd.DataFrame([(*key, int(ids[i]), cn, a, z, q) for i, cn, a, z, q in got], columns=[*by, "s", "cn", "first_w", "last_w", "qs"])

    keys = "".join(f"{c} string, " for c in by)
    return d.groupBy(*by, "chrom", "part").applyInPandas(run, f"{keys}s int, cn int, first_w int, last_w int, qs double")
