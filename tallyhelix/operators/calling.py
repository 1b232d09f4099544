"""Calling per cluster, from counts to genotypes: models, priors, transitions and decoding of all clusters in one plan.

A cluster's models are fitted on its own samples and those of the clusters it fits with; only its own samples are called.
Male clusters are haploid on the sex chromosomes. The driver holds a few numbers per cluster: priors, transitions, cutoffs. Models, likelihoods and calls are written, so that a lost executor costs a step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhelix.session import written

from . import calls as ca
from . import models as mo
from .hmm import MAX_ROUNDS, viterbi
from .models import best_state
from .reuse import samples_of_clusters

BY = ("cluster_id",)


def pool(cells: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, haploid, role, s, widx, chrom, wtype, fpm): cells that each valid cluster works on; role 1 for its own samples, 2 for those it fits with."""
    valid = clusters.where("valid = 1")
    roles = samples_of_clusters(clusters, members).join(valid.select("cluster_id", (F.col("cluster_id").startswith("G") & (F.col("gender") == "M")).alias("haploid")), "cluster_id")
    own = F.col("wtype") == F.when(F.col("cluster_id").startswith("A"), 0).otherwise(1)
    # one row per sample and cluster
    return cells.join(F.broadcast(roles), "s").where(own | (F.col("wtype") == 2)).select("cluster_id", "haploid", "role", "s", "widx", "chrom", "wtype", "fpm")


def models(p: DataFrame) -> DataFrame:
    """(cluster_id, haploid, widx, ecode, mu, sd, sd0, ...) of every exon and cluster."""
    key = ("cluster_id", "haploid")
    return mo.ecodes(mo.fitted(p.where("wtype <> 2"), key), mo.cn0(p, key), key, F.col("haploid"))


def likelihoods(p: DataFrame, m: DataFrame) -> DataFrame:
    """(cluster_id, haploid, s, widx, fpm, mu, l0..l3) of the clusters' own samples."""
    return mo.likelihoods(p.where("role = 1 and wtype <> 2"), m, F.col("haploid"), ("cluster_id", "haploid"))


def _table(spark, numbers: dict, name: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(c, [float(x) for x in v]) for c, v in sorted(numbers.items())], f"cluster_id string, {name} array<double>"))


def _state(p: str = "p"):
    return best_state(*[F.col(p)[i] for i in range(4)])


def priors(lik: DataFrame) -> dict[str, list[float]]:
    """Shares of states per cluster, iterated until they repeat to three digits."""
    spark = lik.sparkSession
    lik = lik.select("cluster_id", "l0", "l1", "l2", "l3").persist()
    try:
        now = {r["cluster_id"]: [1.0] * 4 for r in lik.select("cluster_id").distinct().collect()}
        seen, open_ = {}, set(now)
        for _ in range(MAX_ROUNDS):
            if not open_:
                break
            n = {c: [1] * 4 for c in open_}  # four numbers per cluster
            known = _table(spark, {c: now[c] for c in open_}, "p")
            for r in lik.join(known, "cluster_id").select("cluster_id", _state().alias("cn")).groupBy("cluster_id", "cn").count().collect():
                n[r["cluster_id"]][r["cn"]] += r["count"]
            for c in sorted(open_):
                now[c] = [x / sum(n[c]) for x in n[c]]
                text = [f"{x:.2e}" for x in now[c]]
                if text == seen.get(c):
                    open_.discard(c)
                seen[c] = text
        return now
    finally:
        lik.unpersist()


def cutoffs(m: DataFrame, windows: DataFrame) -> dict[str, tuple[int, int]]:
    """cluster -> (max_ied, dmax): the median and the 0.9 quantile of gaps between its called exons."""
    d = m.where("ecode >= 0").select("cluster_id", "widx").join(windows.select("widx", "chrom", "st", "en"), "widx")
    d = d.withColumn("gap", F.col("st") - F.lag("en").over(Window.partitionBy("cluster_id", "chrom").orderBy("widx")))
    q = d.groupBy("cluster_id").agg(F.floor(F.percentile("gap", 0.5)).alias("a"), F.floor(F.percentile("gap", 0.9)).alias("b"))
    return {r["cluster_id"]: (int(r["a"] or 0), int(r["b"] or 1)) for r in q.collect()}  # two numbers per cluster


def transitions(lik: DataFrame, windows: DataFrame, p: dict, cut: dict) -> dict[str, list[list[float]]]:
    """cluster -> shares of moves between called exons that lie close, one added to each."""
    spark = lik.sparkSession
    d = lik.join(_table(spark, p, "p"), "cluster_id").join(_table(spark, cut, "cut"), "cluster_id").withColumn("state", _state())
    d = d.join(windows.select("widx", "chrom", "st", "en"), "widx")
    by = Window.partitionBy("cluster_id", "s", "chrom").orderBy("widx")
    d = d.select("cluster_id", F.lag("state").over(by).alias("prev"), F.col("state").alias("cur"), (F.col("st") - F.lag("en").over(by)).alias("gap"), "cut")
    n = {c: [[1] * 4 for _ in range(4)] for c in p}  # sixteen numbers per cluster
    for r in d.where(F.col("gap") <= F.col("cut")[0]).groupBy("cluster_id", "prev", "cur").count().collect():
        n[r["cluster_id"]][r["prev"]][r["cur"]] += r["count"]
    return {c: [[x / sum(row) for x in row] for row in rows] for c, rows in n.items()}


def call(cells: DataFrame, clusters: DataFrame, members: DataFrame, windows: DataFrame, min_gq: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(calls, models): CNVs (cluster_id, s, cn, first_w, last_w, qs) of all samples of valid clusters."""
    p = pool(cells, clusters, members)
    m = written(models(p), "models")  # a row per exon and cluster
    lik = written(likelihoods(p, m), "likelihoods")
    prior, cut = priors(lik), cutoffs(m, windows)
    trans = transitions(lik, windows, prior, cut)
    found = viterbi(lik, windows, {c: (trans[c], prior[c], cut[c][1]) for c in prior}, min_gq, BY)
    return written(found, "calls"), m


def genotypes(cells: DataFrame, clusters: DataFrame, members: DataFrame, windows: DataFrame, bps: DataFrame, padding: int = 0, min_gq: float = 5.0, keep: bool = False) -> DataFrame:
    """(chrom, pos, end_pos, alt, s, gt, gq, fr, bpr, bp) of all clusters; with ``keep`` the cluster_id as well."""
    found, m = call(cells, clusters, members, windows, min_gq)
    own = windows.where("wtype <> 2")
    rated = ca.frag_ratios(found, cells, m, BY)
    return ca.genotypes(ca.with_breakpoints(ca.break_ranges(rated, own, m, padding, BY), bps, BY), BY if keep else ())
