"""A cohort from files of alignments to one variant file, in a folder that later runs take up.

A run's folder has the windows, the counts and breakpoints of each sample, the variant file of each cluster, and logs of what is done. Results are
written aside, under names of their own; a row in a log is what makes them part of the run, so a step that fails or is repeated leaves nothing half
done, and nothing that is logged is ever overwritten: of two rows for one sample the first counts. A sample that fails leaves the run and does not stop the others.

What an earlier run over the same windows has is linked: its counts by sample, and its variant files by cluster where samples, partners and least score are the same.
"""

from __future__ import annotations

import logging
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhelix.functions.scalar import window_type
from tallyhelix.operators import calling, cluster, merging, reuse
from tallyhelix.operators import calls as ca
from tallyhelix.operators import fragments as fr
from tallyhelix.operators import models as mo
from tallyhelix.operators import windows as wi
from tallyhelix.session import written
from tallyhelix.sources import bam, sinks, text

log = logging.getLogger(__name__)

#: Samples that are counted in one job, and jobs that run side by side.
BATCH, TOGETHER = 64, 4
WINDOW = ["widx", "chrom", "st", "en", "id", "wtype"]
COUNTED = "sample string, counts string, breakpoints string, at double, key string"
CALLED = "cluster_id string, file string, samples array<string>, fit_with string, min_gq string, at double, key string"


def windows_of(bed: DataFrame, padding: int = 10) -> DataFrame:
    """widx, chrom, st, en, id, wtype from lines of a BED file: padded, merged, with pseudo-exons, in genome order."""
    merged = written(wi.merged(text.bed(bed, padding)), "merged")
    w = wi.genome_sorted(written(wi.with_pseudo_exons(merged), "windows"))
    return w.withColumn("wtype", window_type(F.col("id"), F.col("chrom"))).select(*WINDOW)


def read_alignments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Of samples by name: binary files, or folders of them, all at once; files of lines, and Parquet, one by one."""
    binary = {s: p for s, p in paths.items() if p.rstrip("/").endswith(".bam")}
    out = bam.read_bam(spark, list(binary.values()))
    for s, p in paths.items():
        if s not in binary:
            one = text.read_sam(spark, [p]) if p.endswith((".sam", ".sam.gz")) else spark.read.parquet(p)
            out = out.unionByName(one.withColumn("sample", F.lit(s)).select(*out.columns))
    return out


class Run:
    """A run's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A log, or no rows where there is none yet."""
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")  # a pattern, for logs
            found.limit(1).count()
            return found
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        if rows:
            # a folder for each entry, as writers of one folder would clear away each other's temporary files
            self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.path}/{name}/{uuid.uuid4().hex}")

    def windows(self) -> DataFrame | None:
        found = self._read("windows", "widx long, chrom string, st long, en long, id string, wtype int")
        return None if found.isEmpty() else found

    def begin(self, windows: DataFrame) -> None:
        """Gives the run its windows; one that has others is an error."""
        own = self.windows()
        if own is None:
            windows.select(*WINDOW).write.mode("errorifexists").parquet(f"{self.path}/windows")
        elif not same(own, windows):
            raise ValueError(f"{self.path} holds a run over other windows")

    def counted(self) -> dict[str, tuple[str, str]]:
        """sample -> (folder of its counts, of its breakpoints): a row a sample, the first that was logged."""
        rows = self._read("counted/*", COUNTED).collect()
        return {r["sample"]: (r["counts"], r["breakpoints"]) for r in sorted(rows, key=lambda r: (r["at"], r["key"]), reverse=True)}

    def log_counted(self, rows: list[tuple[str, str, str]]) -> None:
        self._append("counted", [(*r, time.time(), uuid.uuid4().hex) for r in rows], COUNTED)

    def counts(self, samples: list[str] | None = None) -> DataFrame:
        """sample, widx, n of the samples, or of all."""
        known = self.counted()
        paths = [known[s][0] for s in (sorted(known) if samples is None else samples)]
        schema = "sample string, widx long, n long"
        return text.must(self.spark.read.schema(schema).parquet(*paths), F.col("n") >= 0, "bad count of window", "widx") if paths else self.spark.createDataFrame([], schema)

    def breakpoints(self, samples: list[str], least: int = 2) -> DataFrame:
        """sample, chrom, bp_start, bp_end, cnvtype, n_qnames."""
        known = self.counted()
        samples = [s for s in samples if known[s][1]]
        folders = [(known[s][1].rsplit("/", 1)[1], s) for s in samples]
        if not folders:
            return text.breakpoint_table(self.spark.createDataFrame([], "value string, sample string"), least)
        of = F.broadcast(self.spark.createDataFrame(folders, "folder string, sample string"))  # a row per sample
        lines = self.spark.read.text([known[s][1] for s in samples]).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
        return text.breakpoint_table(lines.join(of, "folder").select("value", "sample"), least)

    def called(self) -> list:
        """Rows of ``CALLED``, the first of each cluster."""
        rows = sorted(self._read("called/*", CALLED).collect(), key=lambda r: (r["at"], r["key"]), reverse=True)
        return list({r["cluster_id"]: r for r in rows}.values())


def same(a: DataFrame, b: DataFrame) -> bool:
    key = ["widx", "chrom", "st", "en", "id"]
    return reuse.equal(a.select(*key), b.select(*key)).first()["same"]


@dataclass
class Counted:
    """Samples by what became of them; failed ones with the reason."""

    kept: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    counted: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def named(paths: list[str]) -> dict[str, str]:
    """sample -> path, in the order of samples; a sample that repeats is an error."""
    out: dict[str, str] = {}
    for p in paths:
        sample = re.sub(r"\.[bs]am(\.gz)?$", "", p.rstrip("/").split("/")[-1])
        if sample in out:
            raise ValueError(f"sample given twice: {sample}")
        if not re.fullmatch(r"[\w.+@~-]+", sample):
            raise ValueError(f"sample with signs that paths can't have: {sample}")
        out[sample] = p
    return dict(sorted(out.items()))


def count(spark: SparkSession, paths: list[str], windows: DataFrame, out: str, previous: list[str] = (), max_gap: int = 1000, together: int = TOGETHER, batch: int = BATCH) -> Counted:
    """Counts and breakpoints of every sample: kept where the run has them, linked where the best of the earlier runs has them, else worked out.

    Samples are counted in batches; those of a batch that fails are counted one by one, so that only what is broken is left out.
    """
    run, wanted, done = Run(spark, out), named(paths), Counted()
    run.begin(windows)
    windows = run.windows()
    done.kept = [s for s in wanted if s in run.counted()]
    todo = [s for s in wanted if s not in done.kept]
    if todo and previous:
        earlier = {p: r.counted() for p in previous if (r := Run(spark, p)).windows() is not None and same(r.windows(), windows)}
        rows = [(p, s) for p, known in earlier.items() for s in known]
        runs, need = spark.createDataFrame(rows, "run string, s string"), spark.createDataFrame([(s,) for s in todo], "s string")
        best = reuse.best_previous(runs, need).first()
        if best is not None:
            known = earlier[best["run"]]
            done.linked = [s for s in todo if s in known]
            run.log_counted([(s, *known[s]) for s in done.linked])
            todo = [s for s in todo if s not in known]

    def work(samples: list[str]) -> None:
        key = uuid.uuid4().hex
        counts, bps = f"{run.path}/counts/{key}", f"{run.path}/breakpoints/{key}"
        frags = written(fr.fragments(read_alignments(spark, {s: wanted[s] for s in samples}), windows, max_gap), "fragments")
        own = spark.createDataFrame([(s,) for s in samples], "sample string")
        n = fr.counted(fr.overlaps(fr.intervals(frags), windows), own, windows)
        n.withColumn("of", F.col("sample")).write.partitionBy("of").parquet(counts)
        lines = sinks.breakpoint_lines(fr.breakpoints(frags)).withColumn("of", F.col("sample")).select("value", "of")
        lines.write.option("compression", "gzip").partitionBy("of").text(bps)
        run.log_counted([(s, *(_folder_of(f"{base}", s) if s in has else "" for base, has in ((counts, samples), (bps, _written(spark, bps))))) for s in samples])

    def apart(samples: list[str]) -> dict[str, str | None]:
        """sample -> why it failed, or None."""
        try:
            work(samples)
            return dict.fromkeys(samples)
        except Exception as e:  # noqa: BLE001, whatever is wrong with a sample must not stop the others
            if len(samples) > 1:
                log.warning("a batch of %d samples is counted one by one: %s", len(samples), e)
                return {s: why for one in samples for s, why in apart([one]).items()}
            log.warning("no counts of sample %s, which leaves the run: %s", samples[0], e)
            return {samples[0]: str(e)}

    with ThreadPoolExecutor(together) as pool:
        for got in pool.map(apart, [todo[i : i + batch] for i in range(0, len(todo), batch)]):
            done.counted += [s for s, why in got.items() if why is None]
            done.failed.update({s: why for s, why in got.items() if why is not None})
    return done


def _folder_of(base: str, sample: str) -> str:
    """Where Spark puts the rows of a sample that a table is parted by; names have letters, digits and signs that stand as they are in paths."""
    return f"{base}/of={sample}"


def _written(spark: SparkSession, bps: str) -> set[str]:
    """Samples that have breakpoints."""
    return {r["of"] for r in spark.read.schema("value string, of string").text(bps).select("of").distinct().collect()}


@dataclass
class Called:
    """Clusters by what became of their files, and the cohort's file."""

    linked: list[str]
    called: list[str]
    merged: str


def cells_of(run: Run, samples: list[str]) -> DataFrame:
    """s, sample, widx, chrom, st, en, id, wtype, n; s is the sample's place."""
    numbers = run.spark.createDataFrame(list(enumerate(samples)), "s int, sample string")
    return run.counts(samples).join(F.broadcast(numbers), "sample").join(fr.sent(run.windows()), "widx").select("s", "sample", *WINDOW, "n")


def grouped(fpm: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) found from the counts: by autosomes, and by sex chromosomes with the sex."""
    auto = cluster.clusters(cluster.grown(fpm.where("wtype = 0")), "A", min_samples)
    sex = fpm.where("wtype = 1")
    gono = cluster.clusters(cluster.grown(sex), "G", min_samples)
    found = auto.unionByName(gono)
    genders = cluster.gender(sex, mo.captured(fpm), found.where("cluster_id like 'G%'").select("cluster_id", "s")).select("cluster_id", "gender")
    clusters = found.groupBy("cluster_id").agg(F.first("fit_with").alias("fit_with"), F.first("valid").cast("int").alias("valid")).join(genders, "cluster_id", "left")
    return written(clusters.withColumn("gender", F.coalesce("gender", F.lit(""))), "clusters"), found.select("cluster_id", "s")


def call(spark: SparkSession, out: str, previous: list[str] = (), min_gq: float = 5.0, padding: int = 10, min_samples: int = 20, date: str | None = None, command: str = "", together: int = TOGETHER) -> Called:
    """Clusters of the run's samples, a variant file for each valid one, and the merged file of all samples."""
    run = Run(spark, out)
    samples, windows = sorted(run.counted()), run.windows()
    fpm = written(mo.fpm(cells_of(run, samples)), "fpm")
    clusters, members = grouped(fpm, min_samples)
    sinks.write_clusters(clusters, members.withColumn("sample", F.element_at(F.array(*map(F.lit, samples)), F.col("s") + 1)), f"{run.path}/clusters")
    of: dict[str, list[str]] = {}
    for r in members.collect():  # a row per sample and kind
        of.setdefault(r["cluster_id"], []).append(samples[r["s"]])
    table = {r["cluster_id"]: r for r in clusters.collect()}
    open_ = [c for c, r in sorted(table.items()) if r["valid"]]

    files: dict[str, str] = {}
    earlier = [(f"{r['cluster_id']} {i}", r) for i, p in enumerate([out, *previous]) if (e := Run(spark, p)).windows() is not None and same(e.windows(), windows) for r in e.called()]
    if earlier:
        names = members.withColumn("s", F.element_at(F.array(*map(F.lit, samples)), F.col("s") + 1))
        old = spark.createDataFrame([(c, s, r["min_gq"]) for c, r in earlier for s in r["samples"]], "cluster_id string, s string, min_gq string")
        for r in reuse.reusable_clusters(clusters, names, old, str(min_gq)).orderBy("prev").collect():
            files.setdefault(r["cluster_id"], dict(earlier)[r["prev"]]["file"])
    linked = sorted(files)
    todo = [c for c in open_ if c not in files]
    if todo:
        only = clusters.withColumn("valid", F.when(F.col("cluster_id").isin(todo), F.col("valid")).otherwise(0))
        numbers = spark.createDataFrame(list(enumerate(samples)), "s int, sample string")
        bps = run.breakpoints(samples).join(F.broadcast(numbers), "sample")
        g = written(calling.genotypes(fpm, only, members, windows, bps, padding, min_gq, keep=True), "genotypes")

        def one(c: str) -> tuple:
            path = f"{run.path}/calls/{c}-{uuid.uuid4().hex}"
            own = {samples.index(s): s for s in sorted(of[c])}
            head = sinks.vcf_header(list(own.values()), min_gq, date or time.strftime("%y%m%d"), command)
            sinks.write_lines(ca.variant_lines(ca.variant_rows(g.where(F.col("cluster_id") == c), own)), path, head, list(ca.ROW_ORDER))
            return c, path, sorted(of[c]), table[c]["fit_with"], str(min_gq), time.time(), uuid.uuid4().hex

        with ThreadPoolExecutor(together) as pool:
            rows = list(pool.map(one, todo))
        run._append("called", rows, CALLED)
        files.update({r[0]: r[1] for r in rows})
    merged = f"{run.path}/merged-{uuid.uuid4().hex}"
    if files:
        merging.merge_files(spark, [files[c] for c in sorted(files)], samples, merged)
    return Called(linked, todo, merged)


def cohort(spark: SparkSession, paths: list[str], bed: str, out: str, previous: list[str] = (), padding: int = 10, max_gap: int = 1000, min_samples: int = 20, min_gq: float = 5.0) -> tuple[Counted, Called]:
    """From files of alignments and a BED file to the variant file of the cohort."""
    windows = written(windows_of(text.read_lines(spark, bed), padding), "windows")
    done = count(spark, paths, windows, out, previous, max_gap)
    return done, call(spark, out, previous, min_gq, padding, min_samples)
