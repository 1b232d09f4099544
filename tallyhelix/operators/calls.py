"""Calls to genotypes: ratios, breakpoint ranges, recalibration, rows of variant files, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhelix.functions.scalar import genotype, sv_type, vcf_key, vcf_pos
from tallyhelix.session import written

from .ranges import containing


def frag_ratios(calls: DataFrame, cells: DataFrame, models: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fr``: mean ratio to the CN2 mean over called exons of each call.

    Sums run along a sample's windows, so a call takes the difference of two rows, at its ends; calls without a called exon go.
    """
    key = [*by, "s"]
    if by:  # the cells of each cluster that has calls of the sample
        cells = cells.join(calls.select(*key).distinct(), "s")
    along = Window.partitionBy(*key).orderBy("widx").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.when(F.col("mu").isNotNull(), F.col("fpm") / F.col("mu"))
    c = cells.join(models.where("ecode >= 0").select(*by, "widx", "mu"), [*by, "widx"], "left").withColumn("ratio", ratio)
    c = c.select(*key, "widx", "ratio", F.coalesce(F.sum("ratio").over(along), F.lit(0.0)).alias("run"), F.count("ratio").over(along).alias("k"))
    own = F.coalesce("ratio", F.lit(0.0))
    first = c.select(*key, F.col("widx").alias("first_w"), (F.col("run") - own).alias("run0"), (F.col("k") - F.col("ratio").isNotNull().cast("long")).alias("k0"))
    last = c.select(*key, F.col("widx").alias("last_w"), F.col("run").alias("run1"), F.col("k").alias("k1"))
    out = calls.join(first, [*key, "first_w"]).join(last, [*key, "last_w"]).where("k1 > k0").withColumn("fr", (F.col("run1") - F.col("run0")) / (F.col("k1") - F.col("k0")))
    return out.select(*calls.columns, "fr")


def break_ranges(calls: DataFrame, windows: DataFrame, models: DataFrame, padding: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds chrom, pos, end_pos and the ranges s1-e1, s2-e2 where breakpoints may lie.

    s1 follows the called exon before on the chromosome, e2 precedes the called exon after it; with
    none after it, e2 precedes the chromosome's last exon.
    """
    if by:  # the windows of each cluster
        windows = windows.crossJoin(F.broadcast(models.select(*by).distinct()))
    w = windows.join(models.select(*by, "widx", (F.col("ecode") >= 0).alias("called")), [*by, "widx"], "left").withColumn("called", F.coalesce("called", F.lit(False)))
    along = Window.partitionBy(*by, "chrom").orderBy("widx")
    before = F.last(F.when(F.col("called"), F.col("en")), True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col("called"), F.col("st")), True).over(along.rowsBetween(1, Window.unboundedFollowing))
    end = F.max_by("st", "widx").over(Window.partitionBy(*by, "chrom"))
    w = w.select(*by, "widx", "chrom", "st", "en", F.coalesce(before + 1, F.lit(0)).alias("s1"), F.coalesce(after - 1, end - 1).alias("e2"))
    a = w.select(*by, F.col("widx").alias("first_w"), "chrom", vcf_pos(F.col("st"), padding).cast("long").alias("pos"), "s1")
    z = w.select(*by, F.col("widx").alias("last_w"), (F.col("en") - padding).cast("long").alias("end_pos"), "e2")
    return calls.join(a, [*by, "first_w"]).join(z, [*by, "last_w"]).withColumn("e1", F.col("pos")).withColumn("s2", F.col("end_pos") + 1)


def with_breakpoints(ranged: DataFrame, bps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``bp``: split-read breakpoints of the sample and type within both ranges, ``start-end-n``."""
    ranged = written(ranged, "ranged")  # a row per call, needed for its levels, its bins and itself
    b = bps.where("n_qnames >= 2").select("s", "chrom", F.col("cnvtype").alias("svtype"), "bp_start", "bp_end", "n_qnames")
    key = [*by, "s", "cn", "first_w", "last_w"]
    c = ranged.select(*key, "chrom", sv_type(F.col("cn")).alias("svtype"), "s1", "e1", "s2", "e2")
    item = F.struct("bp_start", "bp_end", "n_qnames")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws("-", x["bp_start"].cast("string"), x["bp_end"].cast("string"), x["n_qnames"].cast("string"))), ",")
    got = containing(c, b, ["s", "chrom", "svtype"], ("s1", "e1"), ("s2", "e2"), ("bp_start", "bp_end")).groupBy(*key).agg(text.alias("bp"))
    return ranged.withColumn("svtype", sv_type(F.col("cn"))).join(got, key, "left")


def recalibrated(calls: DataFrame, samples: int, most: dict[int, float], min_gq: float) -> DataFrame:
    """Scores lowered so that at most floor(samples * most) calls of each state stay; only what exceeds min_gq stays."""
    by = Window.partitionBy("cn").orderBy(F.desc("qs"))
    limits = calls.sparkSession.createDataFrame([(k, int(samples * v) + 1) for k, v in most.items()], "cn int, rank int")
    # a constant bound on the rank lets each partition keep its best rows only
    ranked = calls.select("cn", "qs", F.row_number().over(by).alias("rank")).where(F.col("rank") <= max(int(samples * v) + 1 for v in most.values()))
    less = ranked.join(F.broadcast(limits), ["cn", "rank"]).select("cn", (F.col("qs") - min_gq).alias("less"))
    out = calls.join(less, "cn", "left").withColumn("qs", F.col("qs") - F.coalesce("less", F.lit(0.0)))
    return out.where(F.col("qs") > min_gq).drop("less")


def genotypes(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, chrom, pos, end_pos, alt, s, gt, gq, fr, bpr, bp): one row per call, the long form of a variant file."""
    gq = F.bround(F.least(F.col("qs"), F.lit(100.0)), 0).cast("int")
    bpr = F.format_string("%d-%d,%d-%d", "s1", "e1", "s2", "e2")
    return calls.select(*by, "chrom", "pos", "end_pos", F.concat(F.lit("<"), sv_type(F.col("cn")), F.lit(">")).alias("alt"), "s", genotype(F.col("cn"), F.col("fr")).alias("gt"), gq.alias("gq"), F.round("fr", 2).alias("fr"), bpr.alias("bpr"), *(["bp"] if "bp" in calls.columns else []))


#: Columns in which the rows of a variant file are sorted.
ROW_ORDER = ("_key", "POS", "_end", "ALT")


def variant_rows(geno: DataFrame, names: dict[int, str]) -> DataFrame:
    """Wide rows of a variant file, one text column per sample, ``0/0`` where it has no call; and what they are sorted by besides POS and ALT: _key, _end."""
    text = F.concat_ws(":", "gt", F.col("gq").cast("string"), F.format_string("%.2f", "fr"), "bpr", *(["bp"] if "bp" in geno.columns else []))
    wide = geno.withColumn("text", text).groupBy("chrom", "pos", "end_pos", "alt").pivot("s", list(names)).agg(F.first("text"))
    kind = F.regexp_replace("alt", "[<>]", "")
    form = F.lit("GT:GQ:FR:BPR")
    if "bp" in geno.columns:
        some = geno.groupBy("chrom", "pos", "end_pos", "alt").agg(F.max(F.col("bp").isNotNull()).alias("has_bp"))
        wide = wide.join(some, ["chrom", "pos", "end_pos", "alt"])
        form = F.when(F.col("has_bp"), "GT:GQ:FR:BPR:BP").otherwise(form)
    cells = [F.coalesce(F.col(f"`{s}`"), F.lit("0/0")).alias(n) for s, n in names.items()]
    return wide.select(F.col("chrom").alias("#CHROM"), F.col("pos").alias("POS"), F.lit(".").alias("ID"), F.lit("N").alias("REF"), F.col("alt").alias("ALT"), F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), F.concat(F.lit("SVTYPE="), kind, F.lit(";END="), F.col("end_pos").cast("string")).alias("INFO"), form.alias("FORMAT"), *cells, vcf_key(F.col("chrom")).alias("_key"), F.col("end_pos").alias("_end"))


def variant_lines(wide: DataFrame) -> DataFrame:
    """(value, and the columns of ``ROW_ORDER``): rows of a variant file as text."""
    shown = [c for c in wide.columns if not c.startswith("_")]
    return wide.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in shown]).alias("value"), *ROW_ORDER)


def merged_sites(parts: list[DataFrame], samples: DataFrame) -> DataFrame:
    """(chrom, pos, end_pos, alt, ckey, form, s, text): all sites of all files by all samples, ``0/0`` where absent, with the sort key.

    ``form`` is the longest FORMAT that any file has for the site.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    key = ["chrom", "pos", "end_pos", "alt"]
    sites = every.groupBy(*key).agg(F.max_by("form", F.length("form")).alias("form")).withColumn("ckey", vcf_key(F.col("chrom")))
    return sites.crossJoin(F.broadcast(samples.select("s"))).join(every.select(*key, "s", "text"), [*key, "s"], "left").withColumn("text", F.coalesce("text", F.lit("0/0")))
