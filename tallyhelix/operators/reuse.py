"""Reuse of earlier runs, and how clusters, samples and regions relate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fragments import sent
from .ranges import overlapping


def _fit_edges(clusters: DataFrame) -> DataFrame:
    """(cluster_id, i, f): one row per partner to fit with, in order."""
    return clusters.where("fit_with <> ''").select("cluster_id", F.posexplode(F.split("fit_with", ",")).alias("i", "f"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether two tables hold the same rows, repeats counted."""
    tagged = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    per = tagged.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return per.agg((F.count("*") == 0).alias("same"))


def from_previous(samples: DataFrame, windows: DataFrame, previous: DataFrame, previous_windows: DataFrame) -> DataFrame:
    """(s, widx, n, done): counts of samples that an earlier run over the same windows has; n is null for the rest."""
    key = ["widx", "chrom", "st", "en", "id"]
    same = F.broadcast(equal(windows.select(*key), previous_windows.select(*key)))  # one row
    known = previous.select("s").distinct().crossJoin(same).where("same").select("s", F.lit(True).alias("_known"))
    every = samples.select("s").crossJoin(sent(windows.select("widx"))).join(known, "s", "left")
    out = every.join(previous, ["s", "widx"], "left").withColumn("done", F.coalesce("_known", F.lit(False)))
    return out.select("s", "widx", F.when(F.col("done"), F.coalesce("n", F.lit(0))).alias("n"), "done")


def best_previous(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (run, common, others): most samples in common, then fewest others; none without any in common."""
    hit = runs.join(wanted.select("s", F.lit(1).alias("_w")), "s", "left")
    per = hit.groupBy("run").agg(F.count("_w").alias("common"), (F.count("*") - F.count("_w")).alias("others"))
    return per.where("common > 0").orderBy(F.desc("common"), "others", "run").limit(1)


def exons_of_regions(regions: DataFrame, clusters: DataFrame, members: DataFrame, windows: DataFrame) -> DataFrame:
    """(sample, chrom, st, en, cluster_id, widx, problem): regions with the cluster of their sample and the exons that they overlap.

    A region on a chromosome with autosome exons looks in the sample's A cluster, one on other chromosomes in its G cluster. What finds no exon comes
    once, without one, and with the reason: no such sample, no such chromosome, cluster not valid, no exon there.
    """
    g = regions.distinct().select("sample", "chrom", F.col("st").alias("g_st"), F.col("en").alias("g_en"))
    exons = windows.where("wtype in (0, 1)").select("widx", F.col("chrom"), "st", "en", "wtype")
    kinds = exons.groupBy("chrom").agg(F.when(F.min("wtype") == 0, "A").otherwise("G").alias("kind"))
    of = members.join(clusters.select("cluster_id", "valid"), "cluster_id").select("sample", "cluster_id", "valid", F.substring("cluster_id", 1, 1).alias("kind"))
    known = members.select("sample").distinct().withColumn("_known", F.lit(True))
    g = g.join(known, "sample", "left").join(kinds, "chrom", "left").join(of, ["sample", "kind"], "left")
    e = exons.select("chrom", F.col("widx"), "st", "en", F.when(F.col("wtype") == 0, "A").otherwise("G").alias("kind"))
    of_valid = g.where("valid = 1").select("sample", "chrom", "g_st", "g_en", "kind")
    found = overlapping(of_valid, e, ["chrom", "kind"], ("g_st", "g_en"), ("st", "en")).select("sample", "chrom", "g_st", "g_en", "kind", "widx")
    hit = g.join(found, ["sample", "chrom", "g_st", "g_en", "kind"], "left")
    problem = F.when(F.col("_known").isNull(), "no such sample").when(F.col("kind").isNull(), "no such chromosome").when(F.coalesce(F.col("valid"), F.lit(0)) != 1, "cluster not valid").when(F.col("widx").isNull(), "no exon there")
    return hit.select("sample", "chrom", F.col("g_st").alias("st"), F.col("g_en").alias("en"), "cluster_id", "widx", problem.alias("problem"))


def samples_of_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, s, role): 1 for members, 2 for samples of clusters to fit with, which wins."""
    fit = _fit_edges(clusters).join(members.select(F.col("cluster_id").alias("f"), "s"), "f").select("cluster_id", "s", F.lit(2).alias("role"))
    return members.select("cluster_id", "s", F.lit(1).alias("role")).unionByName(fit).groupBy("cluster_id", "s").agg(F.max("role").alias("role"))


def reference_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster_id, ref): the first partner that itself fits with nobody."""
    free = clusters.where("fit_with = ''").select(F.col("cluster_id").alias("f"))
    return _fit_edges(clusters).join(free, "f").groupBy("cluster_id").agg(F.min_by("f", "i").alias("ref"))


def reusable_clusters(clusters: DataFrame, members: DataFrame, previous: DataFrame, min_gq: str) -> DataFrame:
    """(cluster_id, prev): valid clusters with the same samples as an earlier one of their kind, called with the same least score, all of whose partners match too.

    previous (cluster_id, s, min_gq), the score as text, as the header of the earlier file has it.
    """
    key = lambda m: m.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("k"))
    kind = F.substring("cluster_id", 1, 1).alias("kind")
    now, old = key(members).select("cluster_id", kind, "k"), key(previous.where(F.col("min_gq") == min_gq)).select(F.col("cluster_id").alias("prev"), kind, "k")
    same = now.join(old, ["kind", "k"]).join(clusters.where("valid = 1").select("cluster_id"), "cluster_id").select("cluster_id", "prev")
    broken = _fit_edges(clusters).join(same.select(F.col("cluster_id").alias("f")), "f", "left_anti").select("cluster_id")
    return same.join(broken, "cluster_id", "left_anti")


def numbered_clusters(members: DataFrame) -> DataFrame:
    """(cluster_id, n, name): names by size within a kind."""
    n = members.groupBy("cluster_id").agg(F.count("*").alias("n")).withColumn("kind", F.substring("cluster_id", 1, 1))
    k = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "cluster_id"))
    return n.select("cluster_id", "n", F.format_string("%s_%02d", "kind", k).alias("name"))


def valid_clusters(clusters: DataFrame, members: DataFrame, min_size: int) -> DataFrame:
    """(cluster_id, n, ok, fit_with): clusters judged by rising number of partners; invalid partners are dropped.

    One pass per number of partners; a pass joins the clusters of that number with those judged before.
    """
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    c = clusters.join(size, "cluster_id").withColumn("k", F.when(F.col("fit_with") == "", 0).otherwise(F.size(F.split("fit_with", ","))))
    levels = sorted(row["k"] for row in c.select("k").distinct().collect())  # numbers of partners
    judged = c.where(f"k = {levels[0]}").select("cluster_id", "n", (F.col("n") >= min_size).alias("ok")) if levels and levels[0] == 0 else None
    for k in levels:
        if k == 0:
            continue
        level = c.where(f"k = {k}")
        known = judged if judged is not None else c.where("false").select("cluster_id", "n", F.lit(False).alias("ok"))
        with_sizes = _fit_edges(level).join(known.where("ok").select(F.col("cluster_id").alias("f"), F.col("n").alias("fn")), "f", "left")
        extra = with_sizes.groupBy("cluster_id").agg(F.coalesce(F.sum("fn"), F.lit(0)).alias("extra"))
        here = level.join(extra, "cluster_id").select("cluster_id", "n", (F.col("n") + F.col("extra") >= min_size).alias("ok"))
        judged = here if judged is None else judged.unionByName(here)
    kept = _fit_edges(clusters).join(judged.where("ok").select(F.col("cluster_id").alias("f")), "f")
    kept = kept.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("fit_with"))
    return judged.join(kept, "cluster_id", "left").withColumn("fit_with", F.coalesce("fit_with", F.lit("")))
