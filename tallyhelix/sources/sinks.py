"""Writers: counts, breakpoints, clusters, variant files. Paths are given and overwritten; runs that must not overwrite write through ``plans.run``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhelix.session import written

CLUSTER_HEADER = "CLUSTER_ID\tFIT_WITH\tGENDER\tVALID\tSAMPLES"
BP_HEADER = "CHR\tSTART\tEND\tCNVTYPE\tCOUNT-QNAMES\tQNAMES"


def write_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").option("compression", "zstd").parquet(path)


def breakpoint_lines(bps: DataFrame) -> DataFrame:
    cols = ["chrom", "bp_start", "bp_end", "cnvtype", "n_qnames", "qnames"]
    return bps.select("sample", F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def write_breakpoints(bps: DataFrame, path: str) -> None:
    """One gzipped folder per sample."""
    breakpoint_lines(bps).write.mode("overwrite").partitionBy("sample").option("compression", "gzip").text(path)


def cluster_lines(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters (cluster_id, fit_with comma list, gender, valid) and members (cluster_id, sample) as lines."""
    m = members.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("sample")), ",").alias("samples"))
    fit = F.array_join(F.array_sort(F.split("fit_with", ",")), ",")
    return clusters.join(m, "cluster_id").select("cluster_id", F.concat_ws("\t", "cluster_id", fit, "gender", F.col("valid").cast("string"), "samples").alias("value"))


def write_clusters(clusters: DataFrame, members: DataFrame, path: str) -> None:
    """The table of clusters as one text file, header first, in the order of their ids."""
    write_lines(cluster_lines(clusters, members), path, [CLUSTER_HEADER], ["cluster_id"])


def write_lines(lines: DataFrame, path: str, header: list[str], order: list[str]) -> None:
    """Header lines, then the lines in order, as gzipped text files whose names are in order: one after the other they are one file.

    Lines are dealt to ranges of the order, each of which a task sorts and writes; the header lies before all of them.
    """
    spark = lines.sparkSession
    first = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order]
    top = spark.createDataFrame([(i, h) for i, h in enumerate(header)], "_k int, value string").select("_k", "value", *first)
    # written first, as ranges are drawn from a sample of the lines
    every = top.unionByName(written(lines.select(F.lit(len(header)).alias("_k"), "value", *order), "lines"))
    every.repartitionByRange("_k", *order).sortWithinPartitions("_k", *order).select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def vcf_header(samples: list[str], min_gq: float, date: str, command: str = "") -> list[str]:
    return [
        "##fileformat=VCFv4.3",
        f"##fileDate={date}",
        "##source=tallyhelix",
        f"##tallyhelix_commandLine={command}",
        f"##tallyhelix_minGQ={min_gq}",
        '##ALT=<ID=DEL,Description="Deletion">',
        '##ALT=<ID=DUP,Description="Duplication">',
        '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of variant">',
        '##INFO=<ID=END,Number=1,Type=Integer,Description="End of variant">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality of the call">',
        '##FORMAT=<ID=FR,Number=1,Type=Float,Description="Mean ratio to two copies">',
        '##FORMAT=<ID=BPR,Number=2,Type=String,Description="Ranges of breakpoints">',
        '##FORMAT=<ID=BP,Number=.,Type=String,Description="Split-read breakpoints">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]
