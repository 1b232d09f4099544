"""Parsers of the text formats, from DataFrames of lines (column ``value``), and readers of files.

Malformed rows raise an error; nothing is dropped silently.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

log = logging.getLogger(__name__)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, gzipped or not."""
    return spark.read.text(path)


def fields(sep: str = "\t") -> Column:
    return F.split("value", sep)


def must(df: DataFrame, ok: Column, message: str, value: str = "value") -> DataFrame:
    """The rows, all of which must meet ``ok``; a filter, so it holds whatever columns are read."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.col(value).cast("string"))).cast("boolean")))


def sample_paths(paths: DataFrame) -> DataFrame:
    """(path, sample) in order of samples; a sample that repeats is an error."""
    from tallyhelix.functions.scalar import sample_name

    p = paths.withColumn("sample", sample_name(F.col("path")))
    n = p.groupBy("sample").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return must(n, F.col("n") == 1, "sample given twice", "sample").select("path", "sample").orderBy("sample")


def sam(lines: DataFrame) -> DataFrame:
    """sample, qname, flag, chrom, pos, mapq, cigar, ord from lines with ``sample`` and ``ord``, the order of input; header lines are skipped."""
    f = fields()
    out = must(lines.where(~F.col("value").startswith("@")), (F.size(f) >= 6) & f[1].rlike(r"^\d+$") & f[3].rlike(r"^\d+$") & f[4].rlike(r"^\d+$"), "bad alignment")
    return out.select("sample", f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), f[3].cast("long").alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), "ord")


def read_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Alignments of SAM text files, one per sample, gzipped or not; lines of a file are numbered in its order."""
    from tallyhelix.functions.scalar import sample_name

    lines = spark.read.text(paths).select("value", sample_name(F.col("_metadata.file_path")).alias("sample"), F.monotonically_increasing_id().alias("ord"))
    return sam(lines)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """s, widx, n of a written counts table; negative or missing counts are an error."""
    return must(spark.read.schema("s int, widx long, n long").parquet(path), F.col("n") >= 0, "bad count of window", "widx")


def bed(lines: DataFrame, padding: int = 0) -> DataFrame:
    """chrom, st, en, id with padding on both sides, never below 0; four fields, digits and ids that do not repeat are required."""
    f = fields()
    rows = must(lines, (F.size(f) == 4) & f[1].rlike(r"^\d+$") & f[2].rlike(r"^\d+$"), "bad BED line").select("value", f[3].alias("id"))
    one = must(rows.withColumn("_n", F.count("*").over(Window.partitionBy("id"))), F.col("_n") == 1, "bad BED line, id given twice")
    return one.select(f[0].alias("chrom"), F.greatest(f[1].cast("long") - padding, F.lit(0)).alias("st"), (f[2].cast("long") + padding).alias("en"), "id")


def cluster_table(lines: DataFrame) -> DataFrame:
    """cluster_id, fit_with (array), gender, valid, samples (array)."""
    f = fields()
    ok = (F.size(f) == 5) & f[0].rlike(r"^(A|G)_\d+$") & f[2].isin("M", "F", "") & f[3].isin("0", "1")
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return must(lines.where(~F.col("value").startswith("CLUSTER_ID")), ok, "bad cluster line").select(f[0].alias("cluster_id"), listed(f[1]).alias("fit_with"), f[2].alias("gender"), f[3].cast("int").alias("valid"), listed(f[4]).alias("samples"))


def breakpoint_table(lines: DataFrame, least: int = 2) -> DataFrame:
    """Lines with a ``sample`` column: sample, chrom, bp_start, bp_end, cnvtype, n_qnames of enough support."""
    f = fields()
    out = must(lines.where(~F.col("value").startswith("CHR\t")), F.size(f) == 6, "bad breakpoint line")
    out = out.select("sample", f[0].alias("chrom"), f[1].cast("long").alias("bp_start"), f[2].cast("long").alias("bp_end"), f[3].alias("cnvtype"), f[4].cast("long").alias("n_qnames"))
    return out.where(F.col("n_qnames") >= least)


def read_breakpoints(spark: SparkSession, path: str, samples: list[str], least: int = 2) -> DataFrame:
    """Breakpoints of the samples from a folder with one folder of files per sample; a sample without one is skipped with a warning."""
    lines = spark.read.schema("value string, sample string").text(path)
    found = {r["sample"] for r in lines.select("sample").distinct().collect()}  # names of samples
    for s in samples:
        if s not in found:
            log.warning("no breakpoints of sample %s in %s", s, path)
    return breakpoint_table(lines.where(F.col("sample").isin(samples)), least)


def vcf_genotypes(lines: DataFrame, samples: list[str]) -> DataFrame:
    """chrom, pos, end_pos, alt, sample, text: a row per site and sample."""
    f = fields()
    body = lines.where(~F.col("value").startswith("#"))
    rows = body.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), F.regexp_extract(f[7], r"END=(\d+)", 1).cast("long").alias("end_pos"), f[4].alias("alt"), F.posexplode(F.slice(f, 10, len(samples))).alias("i", "text"))
    return rows.withColumn("sample", F.element_at(F.array(*map(F.lit, samples)), F.col("i") + 1)).drop("i")


def vcf_min_gq(lines: DataFrame) -> DataFrame:
    """One row (min_gq): the least score as the header has it, as text."""
    tag = r"^##\w+_minGQ=(.*)$"
    return lines.where(F.col("value").rlike(tag)).select(F.regexp_extract("value", tag, 1).alias("min_gq"))


def vcf_samples(lines: DataFrame) -> DataFrame:
    """One row per sample column of the header: i, sample."""
    head = lines.where(F.col("value").startswith("#CHROM"))
    return head.select(F.posexplode(F.slice(fields(), 10, F.greatest(F.size(fields()) - 9, F.lit(0)))).alias("i", "sample"))


def regions(lines: DataFrame) -> DataFrame:
    """sample, chrom, st, en of ``sample:chrom:start-end`` items joined by commas; 0 <= start <= end."""
    f = F.split("item", ":")
    r = lines.select("value", F.explode(F.split("value", ",")).alias("item"))
    r = r.select("value", F.size(f).alias("k"), f[0].alias("sample"), f[1].alias("chrom"), F.regexp_extract(f[2], r"^(\d+)-(\d+)$", 1).try_cast("long").alias("st"), F.regexp_extract(f[2], r"^(\d+)-(\d+)$", 2).try_cast("long").alias("en"))
    ok = F.coalesce((F.col("k") == 3) & (F.col("st") <= F.col("en")), F.lit(False))
    return must(r, ok, "bad region").select("sample", "chrom", "st", "en")


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, at): lines of a file or of a folder of files whose names are in order; ``file`` and ``at`` sort them."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))


def vcf_header_lines(spark: SparkSession, path: str) -> list[str]:
    """The header of a variant file, in order: a few lines."""
    return [r["value"] for r in read_in_order(spark, path).where(F.col("value").startswith("#")).orderBy("file", "at").collect()]


#: Quality notes and the sex that they stand for, null for the sex as given; and what names of dated batches begin with.
NOTES = {"": None, "suspected XX": "F", "suspected XXY": "XXY", "suspected XXY or contamination": "XXY", "suspected contamination": None}
DATED = ("Genoscope", "Novogene")


def sex_of(note: Column, sex: Column, notes: dict = NOTES) -> Column:
    """The sex that a quality note stands for, or as given; null for a note that is not known."""
    out = None
    for text, means in notes.items():
        value = sex if means is None else F.lit(means)
        out = F.when(note == text, value) if out is None else out.when(note == text, value)
    return out


def metadata(lines: DataFrame, header: str, notes: dict = NOTES, dated: tuple[str, ...] = DATED) -> DataFrame:
    """sample, sex, batch by the names of the header, in any order; quality notes override the sex, and one that is not known is an error."""
    at = {n: i for i, n in enumerate(header.split("\t"))}
    f = fields()
    get = lambda n: F.coalesce(F.get(f, F.lit(at[n])), F.lit(""))
    rows = must(lines.where(F.col("value") != header).where(~get("sampleID").isin("", "0")), get("Quality control").isin(*notes), "unknown quality note")
    return rows.select(get("sampleID").alias("sample"), sex_of(get("Quality control"), get("Sex"), notes).alias("sex"), batch(get("Center"), get("capture"), get("Date"), dated).alias("batch"))


def batch(center: Column, capture: Column, date: Column, dated: tuple[str, ...] = DATED) -> Column:
    """Centre and capture, and the date as well where that name begins with one of ``dated``."""
    name = F.concat_ws("_", center, capture)
    begins = F.lit(False)
    for d in dated:
        begins = begins | name.startswith(d)
    return F.when(begins, F.concat_ws("_", name, date)).otherwise(name)


def to_check(lines: DataFrame) -> DataFrame:
    """sample, id: two tab-separated columns."""
    f = fields()
    return must(lines, F.size(f) == 2, "two columns are expected").select(f[0].alias("sample"), f[1].alias("id"))
