"""Runs that take up earlier ones, leave out broken samples and overwrite nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhelix.operators import merging
from tallyhelix.plans import run
from tallyhelix.plans.fixture import Fixture
from tallyhelix.session import written
from tallyhelix.sources import bam, sinks, text
from tallyhelix.streaming import ingest

SF = "/root/testdata/sf0.001"
WINDOWS = [(0, "chr1", 100, 300, "E_0", 0), (1, "chr1", 1000, 1200, "E_1", 0), (2, "chr2", 50, 90, "E_2", 0)]
SCHEMA = "widx long, chrom string, st long, en long, id string, wtype int"


def write_sample(at, name, pairs):
    """A pair of reads around each (qname, position)."""
    records = [r for q, p in pairs for r in ((q, 99, 0, p, 60, "50M"), (q, 147, 0, p + 80, 60, "50M"))]
    data = bam.head_bytes([("chr1", 5000), ("chr2", 5000)]) + b"".join(bam.record(*r) for r in records)
    path = at / f"{name}.bam"
    path.write_bytes(bam.packed(data) + bam.LAST_BLOCK)
    return str(path)


def counts(spark, at):
    return {(r["sample"], r.widx): r.n for r in run.Run(spark, str(at)).counts().collect()}


def r_bps(spark, at, samples):
    return sorted(tuple(r) for r in run.Run(spark, str(at)).breakpoints(samples).collect())


def test_breakpoints_of_a_run(spark, tmp_path):
    w = spark.createDataFrame(WINDOWS, SCHEMA)
    split = lambda q: [(q, 99, 0, 100, 60, "50M50S"), (q, 2147, 0, 900, 60, "50S50M"), (q, 147, 0, 960, 60, "60M")]
    for name, n in (("A", 3), ("B", 1), ("C", 0)):
        data = bam.head_bytes([("chr1", 5000)]) + b"".join(bam.record(*r) for k in range(n) for r in split(f"q{k}"))
        (tmp_path / f"{name}.bam").write_bytes(bam.packed(data) + bam.LAST_BLOCK)
    done = run.count(spark, [str(tmp_path / f"{n}.bam") for n in "ABC"], w, str(tmp_path / "run"), batch=2)
    assert done.counted == ["A", "B", "C"] and run.Run(spark, str(tmp_path / "run")).counted()["C"][1] == ""
    assert r_bps(spark, tmp_path / "run", ["A", "B", "C"]) == [("A", "chr1", 149, 900, "DEL", 3)]
    assert {s: n for (s, k), n in counts(spark, tmp_path / "run").items() if k == 0} == {"A": 3, "B": 1, "C": 0}


def test_runs_link_count_and_leave_out(spark, tmp_path):
    w = spark.createDataFrame(WINDOWS, SCHEMA)
    a = write_sample(tmp_path, "A", [("q1", 120), ("q2", 150), ("q3", 1010)])
    b = write_sample(tmp_path, "B", [("q1", 1050)])
    (tmp_path / "C.bam").write_bytes((tmp_path / "A.bam").read_bytes()[:-60])
    c = str(tmp_path / "C.bam")
    one, two, three = (tmp_path / n for n in ("one", "two", "three"))

    first = run.count(spark, [b, a], w, str(one))
    assert (first.counted, first.linked, first.failed) == (["A", "B"], [], {})
    want = {("A", 0): 2, ("A", 1): 1, ("A", 2): 0, ("B", 0): 0, ("B", 1): 1, ("B", 2): 0}
    assert counts(spark, one) == want

    # a broken sample loses itself only, and what is there is kept, even if its file has gone
    os.rename(a, f"{a}.away")
    again = run.count(spark, [a, b, c], w, str(one))
    assert again.kept == ["A", "B"] and list(again.failed) == ["C"] and "broken block" in again.failed["C"]
    assert counts(spark, one) == want

    # a new run over more samples links those of the old one and counts the new ones only
    d = write_sample(tmp_path, "D", [("q9", 130)])
    more = run.count(spark, [a, b, d], w, str(two), previous=[str(tmp_path / "none"), str(one)])
    assert (more.linked, more.counted, more.failed) == (["A", "B"], ["D"], {})
    assert counts(spark, two) == {**want, ("D", 0): 1, ("D", 1): 0, ("D", 2): 0}
    assert run.Run(spark, str(two)).counted()["A"] == run.Run(spark, str(one)).counted()["A"]
    assert {n for key in os.listdir(two / "counts") for n in os.listdir(two / "counts" / key) if n.startswith("of=")} == {"of=D"}
    assert r_bps(spark, two, ["A", "B", "D"]) == []

    # other windows: nothing is linked, and a run does not mix them
    wider = w.withColumn("en", F.col("en") + 5)
    other = run.count(spark, [b], wider, str(three), previous=[str(one)])
    assert (other.linked, other.counted) == ([], ["B"])
    with pytest.raises(ValueError, match="other windows"):
        run.count(spark, [b], w, str(three))
    with pytest.raises(ValueError, match="given twice"):
        run.count(spark, [b, "/elsewhere/B.sam"], w, str(three))


def test_files_that_arrive_are_counted_once(spark, tmp_path):
    w, come = spark.createDataFrame(WINDOWS, SCHEMA), tmp_path / "in"
    come.mkdir()
    write_sample(come, "A", [("q1", 120)])
    write_sample(come, "B", [("q1", 1050)])
    (come / "notes.txt").write_text("not a sample")
    go = lambda mark: ingest.watch(spark, str(come), w, str(tmp_path / "run"), str(tmp_path / mark), files=1).awaitTermination()
    go("mark")
    assert {s for s, _ in counts(spark, tmp_path / "run")} == {"A", "B"}
    write_sample(come, "D", [("q9", 130)])
    go("mark")
    first = run.Run(spark, str(tmp_path / "run")).counted()
    go("another mark")  # all files again
    assert run.Run(spark, str(tmp_path / "run")).counted() == first and set(first) == {"A", "B", "D"}
    whole = tmp_path / "whole"
    run.count(spark, [str(come / f"{n}.bam") for n in "ABD"], w, str(whole))
    assert counts(spark, tmp_path / "run") == counts(spark, whole)


def test_of_two_commits_the_first_counts(spark, tmp_path):
    r = run.Run(spark, str(tmp_path / "run"))
    r.log_counted([("A", "first", "x")])
    r.log_counted([("A", "second", "y"), ("B", "b", "z")])
    assert r.counted() == {"A": ("first", "x"), "B": ("b", "z")}
    assert run.Run(spark, str(tmp_path / "empty")).counted() == {} and run.Run(spark, str(tmp_path / "empty")).windows() is None


def planted(spark, at):
    """A run whose counts and breakpoints are those of the fixture."""
    x = Fixture(spark, SF)
    r = run.Run(spark, str(at))
    r.begin(x.windows)
    cells, bps = written(x.cells, "cells"), written(x.bps, "bps")
    for s, name in x.names.items():
        cells.where(F.col("s") == s).select(F.lit(name).alias("sample"), "widx", "n").coalesce(1).write.parquet(f"{at}/counts/{name}-k")
        lines = sinks.breakpoint_lines(bps.where(F.col("s") == s).withColumn("sample", F.lit(name)).withColumn("qnames", F.lit("q")))
        lines.select("value").coalesce(1).write.text(f"{at}/breakpoints/{name}-k")
    r.log_counted([(n, f"{at}/counts/{n}-k", f"{at}/breakpoints/{n}-k") for n in x.names.values()])
    return x, r


def body(spark, path):
    return [r["value"] for r in text.read_in_order(spark, path).orderBy("file", "at").collect() if not r["value"].startswith("##")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_calls_of_a_run_and_reuse_of_its_files(spark, tmp_path):
    x, r = planted(spark, tmp_path / "one")
    first = run.call(spark, r.path, min_gq=3.0, min_samples=8, date="260101")
    assert first.called and not first.linked
    lines = body(spark, first.merged)
    head, rows = lines[0].split("\t"), [v.split("\t") for v in lines[1:]]
    assert head[9:] == sorted(x.names.values()) and rows and all(len(v) == 33 for v in rows)
    keys = [(int(v[0][3:]) if v[0][3:].isdigit() else 1023, int(v[1])) for v in rows]
    assert keys == sorted(keys)
    # the planted deletion of sample 7 and gain of sample 11
    assert any(v[0] == "chr2" and v[4] == "<DEL>" and v[9 + 7] != "0/0" for v in rows) and any(v[0] == "chr1" and v[4] == "<DUP>" and v[9 + 11] != "0/0" for v in rows)

    # all files of an equal run are taken over; a run with another least score takes none
    _, again = planted(spark, tmp_path / "two")
    second = run.call(spark, again.path, previous=[r.path], min_gq=3.0, min_samples=8, date="260101")
    assert second.linked == first.called and not second.called and body(spark, second.merged) == lines
    _, other = planted(spark, tmp_path / "three")
    third = run.call(spark, other.path, previous=[r.path], min_gq=4.0, min_samples=8, date="260101")
    assert third.called == first.called and not third.linked


def vcf(at, name, samples, rows):
    path = at / name
    path.write_text("\n".join(["##fileformat=VCFv4.3", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]), *["\t".join(r) for r in rows]]) + "\n")
    return str(path)


def site(chrom, pos, end, kind, form, *texts):
    return [chrom, str(pos), ".", "N", f"<{kind}>", ".", "PASS", f"SVTYPE={kind};END={end}", form, *texts]


def test_merged_file_against_a_plain_merge(spark, tmp_path):
    rng = np.random.default_rng(3)
    samples = [f"S{i}" for i in range(7)]
    files, want = [], {}
    for k, own in enumerate((["S0", "S3"], ["S5"], ["S1", "S2", "S6"])):
        rows = {}
        for _ in range(60):
            key = (str(rng.choice(["chr1", "chr2", "chr10", "chrX", "chrUn"])), int(rng.integers(1, 9)) * 100, int(rng.integers(9, 12)) * 100, str(rng.choice(["DEL", "DUP"])))
            rows[key] = site(*key, "GT:GQ" if rng.random() < 0.5 else "GT:GQ:BP", *[f"0/1:{rng.integers(99)}" if rng.random() < 0.6 else "0/0" for _ in own])
        files.append(vcf(tmp_path, f"{k}.vcf", own, [rows[q] for q in sorted(rows)]))
        for key, r in rows.items():
            form, texts = want.setdefault(key, ["", dict.fromkeys(samples, "0/0")])
            want[key][0] = max(form, r[8], key=len)
            texts.update(zip(own, r[9:], strict=True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    merging.merge_files(spark, files, samples, str(tmp_path / "merged"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = body(spark, str(tmp_path / "merged"))
    assert lines[0].split("\t")[9:] == samples
    rows = [v.split("\t") for v in lines[1:]]
    assert {(v[0], int(v[1]), int(v[7].split("END=")[1]), v[4][1:4]): [v[8], dict(zip(samples, v[9:], strict=True))] for v in rows} == want
    rank = {"chr1": 1, "chr2": 2, "chr10": 10, "chrX": 1023}
    order = [(rank.get(v[0], 9999), int(v[1]), int(v[7].split("END=")[1]), v[4]) for v in rows]
    assert order == sorted(order)
    assert len([f for f in os.listdir(tmp_path / "merged") if f.endswith(".gz")]) > 1
    with pytest.raises(ValueError, match="unknown samples"):
        merging.merge_files(spark, files, samples[1:], str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="no line of samples"):
        (tmp_path / "no.vcf").write_text("##x\n")
        merging.merge_files(spark, [str(tmp_path / "no.vcf")], samples, str(tmp_path / "bad"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_windows_of_a_bed_file(spark):
    lines = spark.createDataFrame([(f"chr{c}\t{i * 1000 + (50_000 if i > 7 else 0)}\t{i * 1000 + 120 + (50_000 if i > 7 else 0)}\tx{c}_{i}",) for c in ("1", "X") for i in range(12)] + [("chr2\t5\t90\ty",)], "value string")
    w = run.windows_of(lines, 10).orderBy("widx").collect()
    assert [r.widx for r in w] == list(range(len(w))) and {r.wtype for r in w} == {0, 1, 2} or {r.wtype for r in w} == {0, 1}
    assert [r.chrom for r in w] == sorted((r.chrom for r in w), key=["chr1", "chr2", "chrX"].index)
