"""Hand-computed cases and brute-force checks of the operators."""

import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhelix.functions import scalar as fn
from tallyhelix.operators import cluster as cl
from tallyhelix.operators import fragments as fr
from tallyhelix.operators import hmm
from tallyhelix.operators import models as mo
from tallyhelix.operators import windows as wi
from tallyhelix.sources import sinks, text


def test_cigars_and_flags(spark):
    rows = spark.createDataFrame([("10M5I10M", 20, 1), ("5H10S50M", 50, 16), ("3S4=2X7N9D1I", 22, 4), ("100M", 100, 1)], "c string, n int, first int")
    for r in rows.select("*", fn.cigar_ref_length(F.col("c")).alias("n2"), fn.first_unclipped(F.col("c")).alias("f2")).collect():
        assert (r.n, r["first"]) == (r.n2, r.f2)
    flags = spark.createDataFrame([(99, True), (147, True), (83, False), (163, False)], "flag int, fwd boolean")
    assert all(r.fwd == r.got for r in flags.select("fwd", fn.first_read_forward(F.col("flag")).alias("got")).collect())


#: forward parts, reverse parts, in read order -> intervals and breakpoint, or None
CASES = [
    ([(100, 200)], [(150, 250)], ([(100, 250)], None)),
    ([(100, 200)], [(300, 400)], ([(100, 200), (300, 400)], None)),
    ([(100, 200)], [(1300, 1400)], None),
    ([(300, 400)], [(100, 200)], None),
    ([(100, 150), (500, 600)], [(550, 650)], ([(100, 150), (500, 650)], (150, 500, "DEL"))),
    ([(100, 150), (500, 600)], [(700, 800)], ([(100, 150), (500, 600), (700, 800)], (150, 500, "DEL"))),
    ([(900, 950), (500, 600)], [(550, 650)], ([(500, 650), (900, 950)], (500, 950, "DUP"))),
    ([(640, 700), (500, 600)], [(550, 650)], ([(500, 700)], (500, 700, "DUP"))),
    ([(500, 600)], [(900, 950), (550, 650)], ([(500, 650), (900, 950)], (650, 900, "DEL"))),
    ([(500, 600)], [(100, 150), (550, 650)], ([(100, 150), (500, 650)], (100, 650, "DUP"))),
    ([(500, 600)], [(450, 510), (550, 650)], ([(450, 650)], (450, 650, "DUP"))),
    ([(100, 200), (500, 600)], [(550, 650), (150, 250)], ([(100, 250), (500, 650)], (250, 500, "DEL"))),
    ([(500, 600), (100, 200)], [(150, 250), (550, 650)], ([(100, 250), (500, 650)], (100, 650, "DUP"))),
    ([(100, 200), (500, 600)], [(150, 250), (550, 650)], None),
    ([(100, 200), (150, 300)], [(250, 400)], ([(100, 400)], None)),
]


def test_fragment_interpreter(spark):
    rows = [(str(i), [{"s": s, "e": e} for s, e in f], [{"s": s, "e": e} for s, e in r]) for i, (f, r, _) in enumerate(CASES)]
    q = spark.createDataFrame([("S", q, "chr1", f, r) for q, f, r in rows], "sample string, qname string, chrom string, f array<struct<s:long,e:long>>, r array<struct<s:long,e:long>>")
    got = {int(r.qname): ([(i.s, i.e) for i in r.frag.frags], tuple(r.frag.bp) if r.frag.bp else None) for r in fr.interpreted(q).collect()}
    assert [got.get(i) for i in range(len(CASES))] == [want for *_, want in CASES]


def test_merge_is_idempotent_and_touching(spark):
    w = spark.createDataFrame([("chr1", 10, 20, "a"), ("chr1", 20, 30, "b"), ("chr1", 31, 40, "c"), ("chr2", 5, 50, "d"), ("chr2", 6, 7, "e")], "chrom string, st long, en long, id string")
    once = wi.merged(w)
    assert sorted(tuple(r) for r in once.collect()) == [("chr1", 10, 30, "a-b"), ("chr1", 31, 40, "c"), ("chr2", 5, 50, "d-e")]
    assert sorted(map(tuple, wi.merged(once).collect())) == sorted(map(tuple, once.collect()))


def test_overlap_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    parts = [("S", str(i), "chr1", int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 20000, 200), rng.integers(1, 9000, 200), strict=True))]
    wins = [(i, "chr1", i * 400, i * 400 + 150) for i in range(50)]
    got = fr.overlaps(spark.createDataFrame(parts, "sample string, qname string, chrom string, s long, e long"), spark.createDataFrame(wins, "widx long, chrom string, st long, en long"))
    want = {(q, w) for _, q, _, s, e in parts for w, _, a, z in wins if s < z and a < e}
    assert {(r.qname, r.widx) for r in got.collect()} == want


def test_robust_fit_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.sort(np.concatenate([rng.normal(100, 5, 60), rng.normal(300, 5, 6)]))
    mu, sd = np.median(x), x.std() / 3
    for _ in range(50):
        k = x[np.abs(x - mu) < 2 * sd]
        new = k.mean(), k.std() / fn.TRUNCATED_SD_2
        done = abs(new[0] - mu) + abs(new[1] - sd) <= 1e-5
        mu, sd = new
        if done:
            break
    r = spark.createDataFrame([(x.tolist(),), ([0.0] * 5,)], "x array<double>").select(mo.robust_fit(F.col("x")).alias("f")).collect()
    assert r[0].f.ok and abs(r[0].f.mu - mu) < 1e-9 and abs(r[0].f.sd - sd) < 1e-9
    assert not r[1].f.ok


def test_one_copy_has_half_the_spread(spark):
    cells = spark.createDataFrame([("a", 1, 55.0), ("b", 1, 100.0), ("a", 2, 55.0)], "s string, widx long, fpm double")
    models = spark.createDataFrame([(1, 0, 100.0, 10.0, 2.0), (2, 1, 100.0, 10.0, 2.0)], "widx long, ecode int, mu double, sd double, sd0 double")
    pdf = lambda x, mu, sd: np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
    got = {(r.s, r.widx): r for r in mo.likelihoods(cells, models).collect()}
    assert got["a", 1].l1 == pytest.approx(pdf(55, 50, 5)) and got["b", 1].l1 == pytest.approx(pdf(100, 50, 5))
    assert got["a", 1].l2 == pytest.approx(pdf(55, 100, 10)) and got["a", 2].l1 == 0
    assert {r.l1 for r in mo.likelihoods(cells, models, haploid=True).collect()} == {0.0}


def best_path(lik, trans, prior, st, en, dmax):
    best, at = -1.0, None
    n = len(lik)
    steps = []
    for k in range(n):
        d = dmax if k == 0 else st[k] - en[k - 1] - 1
        steps.append(np.tile(prior, (4, 1)) if d >= dmax else trans + (prior[None, :] - trans) * (d / dmax) ** 5)
    for path in product(range(4), repeat=n):
        p, prev = 1.0, 2
        for k, s in enumerate(path):
            p *= steps[k][prev, s] * lik[k][s]
            prev = s
        if p * (1 if path[-1] == 2 else 1) > best:
            best, at = p, path
    return at


@pytest.mark.parametrize("seed", range(6))
def test_decoder_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    n = 6
    lik = rng.random((n, 4)) ** 3
    trans = np.full((4, 4), 0.05) + np.eye(4) * 0.8
    prior = np.array([0.02, 0.03, 0.9, 0.05])
    st = np.arange(n) * 300
    en = st + 100
    path = best_path(lik, trans, prior, st.tolist(), en.tolist(), 2000)
    got = hmm.decode(list(range(n)), st.tolist(), en.tolist(), lik, trans, prior, 2000, -1e9)
    states = [2] * n
    for cn, a, z, _ in got:
        states[a : z + 1] = [cn] * (z - a + 1)
    assert tuple(states) == path


def test_decoder_empty_and_underflow():
    trans, prior = np.full((4, 4), 0.25), np.full(4, 0.25)
    assert hmm.decode([], [], [], np.zeros((0, 4)), trans, prior, 100, 5) == []
    # exons that no state explains: the first state, at the highest score, each on its own
    assert hmm.decode([0, 1], [0, 50], [10, 60], np.zeros((2, 4)), trans, prior, 100, 5) == [(0, 0, 0, 100.0), (0, 1, 1, 100.0)]


def test_average_linkage_and_clusters():
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(0, 1, (12, 3)), rng.normal(40, 1, (11, 3))])
    tree = cl.linkage(pts)
    assert tree[-1][3] == 23 and [t[2] for t in tree] == sorted(t[2] for t in tree)
    found = cl.clusters_of(tree, 23, 5)
    assert sorted(len(s) for s, _ in found) == [11, 12]
    assert [v for v, _ in cl.validity(found, 12)] == [True, False]


def test_chrom_ranks(spark):
    c = spark.createDataFrame([(x,) for x in ("chr10", "chr2", "chrX", "chrM", "chrUn", "chrY", "chr1")], "chrom string")
    assert [r.chrom for r in wi.chrom_ranks(c).orderBy("rank").collect()] == ["chr1", "chr2", "chr10", "chrX", "chrY", "chrM", "chrUn"]


def test_parsers_reject_bad_lines(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert text.bed(lines("chr1\t5\t20\ta"), 10).first().st == 0
    for bad in (text.bed(lines("chr1\tx\t20\ta")), text.cluster_table(lines("Q_1\t\tM\t1\ta")), text.regions(lines("S:chr1:9-3"))):
        with pytest.raises(Exception, match="bad"):
            bad.collect()
    with pytest.raises(Exception, match="twice"):
        text.sample_paths(spark.createDataFrame([("a/x.bam",), ("b/x.sam",)], "path string")).collect()


def test_files_round_trip(spark, tmp_path):
    bps = spark.createDataFrame([("S1", "chr1", 5, 9, "DEL", 2, "a,b"), ("S2", "chr1", 5, 9, "DUP", 1, "c")], "sample string, chrom string, bp_start long, bp_end long, cnvtype string, n_qnames long, qnames string")
    sinks.write_breakpoints(bps, str(tmp_path / "bp"))
    back = text.breakpoint_table(spark.read.schema("value string, sample string").text(str(tmp_path / "bp")))
    assert [tuple(r) for r in back.collect()] == [("S1", "chr1", 5, 9, "DEL", 2)]


def _plain_windows(n: int, seed: int):
    """Windows of two chromosomes in random order, with ends far ahead, equal starts and touching ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        st = int(rng.integers(0, 3000))
        rows.append((f"chr{1 + int(rng.integers(0, 5) == 0)}", st, st + int(rng.choice([1, 5, 20, 400], p=[0.5, 0.3, 0.19, 0.01])), f"w{i}"))
    return rows


WINDOW_ROWS = "chrom string, st long, en long, id string"


def _ends_before(rows):
    """(row, furthest end before on the chromosome) in genome order."""
    last: dict = {}
    for r in sorted(rows):
        yield r, last.get(r[0])
        last[r[0]] = max(last.get(r[0], r[2]), r[2])


def test_distances_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(wi, "BLOCK", 7, raising=False)
    rows = _plain_windows(200, 3)
    got = wi.distances(spark.createDataFrame(rows, WINDOW_ROWS))
    # no task has a whole chromosome
    assert "windowspecdefinition(chrom" in got._jdf.queryExecution().toString()
    assert not re.search(r"windowspecdefinition\(chrom#\d+, st#", got._jdf.queryExecution().toString())
    want = {(*r, None if end is None else r[1] - end - 1) for r, end in _ends_before(rows)}
    assert {(x.chrom, x.st, x.en, x.id, x.ied) for x in got.collect()} == want
    longest = {c: max([0, *[x[4] for x in want if x[0] == c and x[4] is not None]]) for c in ("chr1", "chr2")}
    assert {x.chrom: x.longest_ied for x in wi.longest_gaps(spark.createDataFrame(rows, WINDOW_ROWS)).collect()} == longest


def test_merging_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(wi, "BLOCK", 3, raising=False)
    rows, isles = _plain_windows(200, 4), []
    for r, end in _ends_before(rows):
        if end is None or end < r[1]:
            isles.append([])
        isles[-1].append(r)
    got = wi.merged(spark.createDataFrame(rows, WINDOW_ROWS))
    assert not re.search(r"windowspecdefinition\(chrom#\d+, st#", got._jdf.queryExecution().toString())
    want = {(i[0][0], i[0][1], max(x[2] for x in i), "-".join(x[3] for x in i)) for i in isles}
    assert max(map(len, isles)) > 3 and {(x.chrom, x.st, x.en, x.id) for x in got.collect()} == want


def test_genome_order_over_ranges(spark):
    rows = [(c.replace("chr1", "chr10"), *x) for c, *x in _plain_windows(100, 5)]
    got = wi.genome_sorted(spark.createDataFrame(rows, WINDOW_ROWS))
    assert not re.search(r"windowspecdefinition\(chrom#\d+, st#", got._jdf.queryExecution().toString())
    want = sorted(rows, key=lambda r: (int(r[0][3:]), *r[1:]))
    assert sorted((x.widx, x.chrom, x.st, x.en, x.id) for x in got.collect()) == [(i, *r) for i, r in enumerate(want)]


def test_pseudo_exons_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for c in ("chr2", "chr1"):
        at = np.cumsum(rng.choice([30, 60, 900, 2000], 80, p=[0.6, 0.3, 0.09, 0.01]))
        rows += [(c, int(s), int(s) + 10, f"{c}_{i}") for i, s in enumerate(at)]
    w = spark.createDataFrame(rows, WINDOW_ROWS)
    whole = sorted(map(tuple, wi.with_pseudo_exons(w).collect()))
    monkeypatch.setattr(wi, "BLOCK", 7, raising=False)
    got = wi.with_pseudo_exons(w)
    assert not re.search(r"windowspecdefinition\(chrom#\d+, st#", got._jdf.queryExecution().toString())
    assert sorted(map(tuple, got.collect())) == whole
    # numbered through in genome order
    new = sorted((int(c[3:]), st, int(name.split("_")[1])) for c, st, _, name in whole if name.startswith("intergenic"))
    assert len(new) > 20 and [k for *_, k in new] == list(range(1, len(new) + 1))
