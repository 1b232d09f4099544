"""One variant file of a cohort from the variant files of its clusters.

Rows of all files are dealt to ranges of their sort key, so that the rows of a site meet and end up in order in one pass; no task has more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhelix.functions.scalar import vcf_key
from tallyhelix.sources.sinks import write_lines
from tallyhelix.sources.text import fields, must, vcf_header_lines

#: What a sample without a call has.
NONE = "0/0"
#: Columns that rows are sorted by.
ORDER = ("ckey", "pos", "end_pos", "alt", "chrom")


def called_rows(spark: SparkSession, files: list[str], samples: list[str]) -> DataFrame:
    """(chrom, pos, end_pos, alt, head, form, called): a row per line of any file, ``called`` its (sample, file, text) other than none.

    Files that lack the line of samples, and samples that are not among the given ones, are errors.
    """
    out = None
    for k, path in enumerate(files):  # as many as clusters
        top = [h for h in vcf_header_lines(spark, path) if h.startswith("#CHROM")]
        if len(top) != 1:
            raise ValueError(f"no line of samples in {path}")
        own = top[0].split("\t")[9:]
        if unknown := sorted(set(own) - set(samples)):
            raise ValueError(f"unknown samples in {path}: {', '.join(unknown)}")
        f = fields()
        body = must(spark.read.text(path).where(~F.col("value").startswith("#")), F.size(f) == 9 + len(own), f"bad line in {path}")
        pairs = F.arrays_zip(F.array(*map(F.lit, own)).alias("sample"), F.slice(f, 10, len(own)).alias("text")) if own else F.array().cast("array<struct<sample:string,text:string>>")
        called = F.filter(F.transform(pairs, lambda q: F.struct(q["sample"].alias("sample"), F.lit(k).alias("file"), q["text"].alias("text"))), lambda q: q["text"] != NONE)
        rows = body.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), F.regexp_extract(f[7], r"END=(\d+)", 1).cast("long").alias("end_pos"), f[4].alias("alt"), F.slice(f, 1, 8).alias("head"), f[8].alias("form"), called.alias("called"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merged_sites(rows: DataFrame) -> DataFrame:
    """(ckey, chrom, pos, end_pos, alt, head, form, called): a row per site, dealt to ranges of ``ORDER`` and sorted; the longest form, and of a sample that several files have the last."""
    key = vcf_key(F.col("chrom")).alias("ckey")
    dealt = rows.select(key, *rows.columns).repartitionByRange(*ORDER)
    entry = F.array_sort(F.flatten(F.collect_list("called")))
    # ranges of the key keep a site's rows together, so this needs no shuffle of its own
    sites = dealt.groupBy(*ORDER).agg(F.first("head").alias("head"), F.max_by("form", F.length("form")).alias("form"), entry.alias("called"))
    last = F.filter("called", lambda q, i: F.coalesce(F.get("called", i + 1)["sample"] != q["sample"], F.lit(True)))
    return sites.withColumn("called", last)


def merged_lines(sites: DataFrame, samples: list[str]) -> DataFrame:
    """(value, and the columns of ``ORDER``)."""
    by = F.map_from_entries(F.transform("called", lambda q: F.struct(q["sample"], q["text"])))
    texts = F.transform(F.array(*map(F.lit, samples)) if samples else F.array().cast("array<string>"), lambda s: F.coalesce(F.try_element_at("_by", s), F.lit(NONE)))
    return sites.withColumn("_by", by).select(F.array_join(F.concat(F.col("head"), F.array("form"), texts), "\t").alias("value"), *ORDER)


def long_rows(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """(chrom, pos, end_pos, alt, ckey, form, sample, text): all sites by all samples, which have a column ``sample``."""
    key = ["chrom", "pos", "end_pos", "alt"]
    given = sites.select(*key, F.explode("called").alias("q")).select(*key, "q.sample", "q.text")
    every = sites.select(*key, "ckey", "form").crossJoin(F.broadcast(samples.select("sample")))  # dense by definition
    return every.join(given, [*key, "sample"], "left").withColumn("text", F.coalesce("text", F.lit(NONE)))


def merge_files(spark: SparkSession, files: list[str], samples: list[str], path: str) -> None:
    """The variant file at ``path`` of all sites of all files, with a column for each of the samples in their order; the header is the first file's."""
    header = [h for h in vcf_header_lines(spark, files[0]) if not h.startswith("#CHROM")]
    header.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))
    write_lines(merged_lines(merged_sites(called_rows(spark, files, samples)), samples), path, header, list(ORDER))
