"""Calling per cluster and the rules taken from the survey, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhelix.functions import scalar as fn
from tallyhelix.operators import calling, hmm, qc, reuse
from tallyhelix.operators import calls as ca
from tallyhelix.operators import cluster as cl
from tallyhelix.operators import models as mo
from tallyhelix.sources import sinks, text


def plain_fit(x):
    """The loop as it is defined, without a cap."""
    x = np.asarray(x, float)
    mu, sd = np.median(x), x.std() / 3
    if mu == 0:
        return None
    mu0, sd0 = mu + 1, sd + 1
    while abs(mu - mu0) + abs(sd - sd0) > 1e-5:
        k = x[(x > mu - 2 * sd) & (x < mu + 2 * sd)]
        if not len(k):
            return None
        mu0, sd0, mu, sd = mu, sd, k.mean(), k.std() / fn.TRUNCATED_SD_2
    return (mu, sd if sd else mu * 0.05) if mu else None


def test_robust_fit_follows_the_loop(spark):
    rng = np.random.default_rng(4)
    rows = [[1, 5, 5, 5, 5, 5, 5, 9], [5.0] * 6, [0, 0, 0, 7], [1, 2, 3, 4, 100], *[np.abs(rng.normal(100, rng.integers(1, 60), 40)).tolist() for _ in range(20)]]
    rows += [np.concatenate([rng.normal(50, 4, 30), rng.normal(90, 9, 30)]).tolist() for _ in range(20)]
    rows = [sorted(float(v) for v in r) for r in rows]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>").select("i", mo.robust_fit(F.col("x")).alias("f")).collect()
    for r in got:
        want = plain_fit(rows[r.i])
        assert r.f.ok == (want is not None)
        if want:
            assert (r.f.mu, r.f.sd) == pytest.approx(want, rel=1e-9)
    assert plain_fit(rows[0]) is None and plain_fit(rows[1]) is None


def test_notes_and_batches(spark):
    head = "Date\tsampleID\tSex\tcapture\tQuality control\tCenter"
    lines = [head, "d1\tA\tM\tk\tsuspected XX\tNovogene", "d1\tB\tM\tk\tsuspected XXY\tNovogene-2", "d2\tC\tF\tk\tsuspected XXY or contamination\tother", "d2\tD\tF\tk\tsuspected contamination\tGenoscope", "d2\tE\tM\tk\t\tLille Genoscope", "d\t0\tM\tk\tanything\tx", "d\t\tM\tk\tanything\tx"]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "value string")
    got = {r["sample"]: (r.sex, r.batch) for r in text.metadata(df(lines), head).collect()}
    assert got == {"A": ("F", "Novogene_k_d1"), "B": ("XXY", "Novogene-2_k_d1"), "C": ("XXY", "other_k"), "D": ("F", "Genoscope_k_d2"), "E": ("M", "Lille Genoscope_k")}
    with pytest.raises(Exception, match="unknown quality note"):
        text.metadata(df([head, "d\tA\tM\tk\tSex_Swap\tx"]), head).count()


def test_checks_hold_whatever_is_read(spark):
    df = lambda x: spark.createDataFrame([(v,) for v in x], "value string")
    for bad, why in ((text.bed(df(["chr1\tx\t20\ta", "chr1\t1\t2\tb"])), "bad BED"), (text.bed(df(["chr1\t1\t2\ta", "chr2\t1\t2\ta"])), "twice"), (text.to_check(df(["a"])), "two columns"), (text.cluster_table(df(["Q\t\tM\t1\ta"])), "bad cluster")):
        with pytest.raises(Exception, match=why):
            bad.count()


def test_sam_files_feed_the_counting(spark, tmp_path):
    body = ["@HD\tVN:1.6", "q1\t99\tchr1\t100\t60\t50M\t=\t200\t0\t*\t*", "q1\t147\tchr1\t200\t60\t50M\t=\t100\t0\t*\t*"]
    (tmp_path / "NA1.sam").write_text("\n".join(body) + "\n")
    (tmp_path / "NA2.sam").write_text("\n".join(body[:2]) + "\n")
    rows = text.read_sam(spark, [str(tmp_path / "NA1.sam"), str(tmp_path / "NA2.sam")]).orderBy("sample", "ord").collect()
    assert [(r["sample"], r.qname, r.flag, r.pos) for r in rows] == [("NA1", "q1", 99, 100), ("NA1", "q1", 147, 200), ("NA2", "q1", 99, 100)]


def test_reuse_asks_for_the_same_least_score(spark):
    c = spark.createDataFrame([("A_01", "", "", 1), ("A_02", "A_01", "", 1)], "cluster_id string, fit_with string, gender string, valid int")
    m = spark.createDataFrame([("A_01", 1), ("A_01", 2), ("A_02", 3)], "cluster_id string, s int")
    old = lambda a, b: m.withColumn("min_gq", F.when(F.col("cluster_id") == "A_01", a).otherwise(b))
    same = lambda p: sorted(r.cluster_id for r in reuse.reusable_clusters(c, m, p, "5.0").collect())
    assert same(old("5.0", "5.0")) == ["A_01", "A_02"]
    assert same(old("5.0", "7.0")) == ["A_01"]
    assert same(old("7.0", "5.0")) == []  # its partner does not match any more


def plain_extremes(y, window):
    def first(start, better):
        at, seen = start, 1
        for i in range(start + 1, len(y)):
            if better(y[i], y[at]):
                at, seen = i, 1
            elif y[i] != y[at]:
                seen += 1
                if seen >= window:
                    return at
        return None

    low = first(0, lambda a, b: a < b)
    return low, None if low is None else first(low, lambda a, b: a > b)


def test_first_low_and_high(spark):
    rng = np.random.default_rng(5)
    curves = [np.round(rng.random(40) * 6).tolist() for _ in range(30)] + [list(range(40, 0, -1)), [3.0] * 40, [5.0, 4, 4, 4, 5, 6, 6, 7, 6, 5, 4, 3, 2, 1, 0]]
    d = spark.createDataFrame([(s, i, float(i), float(v)) for s, y in enumerate(curves) for i, v in enumerate(y)], "s int, i int, x double, y double")
    for r in qc.first_low_and_high(d, 4).collect():
        low, high = plain_extremes(curves[r.s], 4)
        assert (r.low_x, r.high_x) == (low, high)
        assert r.ok == bool(high is not None and curves[r.s][low] and (curves[r.s][high] - curves[r.s][low]) / curves[r.s][low] >= 0.2)


def test_vcf_key_takes_the_whole_digest(spark):
    import hashlib

    names = ["scaffold_7", "chrUn_3", "HLA-A", "7", "chrX"]
    got = {r.c: r.k for r in spark.createDataFrame([(n,) for n in names], "c string").select("c", fn.vcf_key(F.col("c")).alias("k")).collect()}
    for n in names[:3]:
        assert got[n] == 1100 + int(hashlib.sha256(n.removeprefix("chr").encode()).hexdigest(), 16) % 1000
    assert (got["7"], got["chrX"]) == (7, 1023)


def test_variant_files_are_in_genome_order(spark, tmp_path):
    rows = [("chr10", 5, 9, "<DEL>"), ("chr2", 100, 900, "<DEL>"), ("chr2", 20, 90, "<DUP>"), ("chr2", 20, 90, "<DEL>"), ("chrX", 1, 2, "<DEL>")]
    g = spark.createDataFrame([(*r, 0, "0/1", 9, 1.0, "1-2,3-4", None) for r in rows], "chrom string, pos long, end_pos long, alt string, s int, gt string, gq int, fr double, bpr string, bp string")
    names = {0: "a", 1: "b"}
    sinks.write_lines(ca.variant_lines(ca.variant_rows(g, names)), str(tmp_path / "v"), sinks.vcf_header(list(names.values()), 5.0, "260101"), list(ca.ROW_ORDER))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[0] == "##fileformat=VCFv4.3" and lines[-6].startswith("#CHROM")
    assert [tuple(x.split("\t")[i] for i in (0, 1, 4)) for x in lines[-5:]] == [("chr2", "20", "<DEL>"), ("chr2", "20", "<DUP>"), ("chr2", "100", "<DEL>"), ("chr10", "5", "<DEL>"), ("chrX", "1", "<DEL>")]
    assert text.vcf_min_gq(spark.createDataFrame([(x,) for x in lines], "value string")).first().min_gq == "5.0"


def test_merged_sites_take_the_longest_format(spark):
    schema = "chrom string, pos long, end_pos long, alt string, s int, text string, form string"
    a = spark.createDataFrame([("chr1", 1, 9, "<DEL>", 0, "0/1:9", "GT:GQ:FR:BPR")], schema)
    b = spark.createDataFrame([("chr1", 1, 9, "<DEL>", 1, "1/1:8", "GT:GQ:FR:BPR:BP")], schema)
    got = ca.merged_sites([a, b], spark.createDataFrame([(0,), (1,), (2,)], "s int")).collect()
    assert {(r.s, r.text, r.form) for r in got} == {(0, "0/1:9", "GT:GQ:FR:BPR:BP"), (1, "1/1:8", "GT:GQ:FR:BPR:BP"), (2, "0/0", "GT:GQ:FR:BPR:BP")}


def test_regions_try_the_chromosome_s_kind(spark):
    w = spark.createDataFrame([(0, "chr1", 10, 20, 0), (1, "chr1", 50, 60, 0), (2, "chrX", 10, 20, 1), (3, "chr1", 12, 14, 2)], "widx long, chrom string, st long, en long, wtype int")
    c = spark.createDataFrame([("A_01", 1), ("G_01", 1), ("G_02", 0)], "cluster_id string, valid int")
    m = spark.createDataFrame([("A_01", "a"), ("G_01", "a"), ("A_01", "b"), ("G_02", "b")], "cluster_id string, sample string")
    g = [("a", "chr1", 15, 55), ("a", "chrX", 0, 12), ("b", "chrX", 0, 12), ("a", "chr1", 30, 40), ("z", "chr1", 0, 99), ("a", "chr7", 0, 99)]
    got = reuse.exons_of_regions(spark.createDataFrame(g, "sample string, chrom string, st long, en long"), c, m, w).collect()
    assert {(r["sample"], r.chrom, r.cluster_id, r.widx, r.problem) for r in got} == {("a", "chr1", "A_01", 0, None), ("a", "chr1", "A_01", 1, None), ("a", "chrX", "G_01", 2, None), ("b", "chrX", "G_02", None, "cluster not valid"), ("a", "chr1", "A_01", None, "no exon there"), ("z", "chr1", None, None, "no such sample"), ("a", "chr7", None, None, "no such chromosome")}


def pdf(x, mu, sd):
    return np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


def plain_calls(fpm, kind, wins, own, fit, haploid, min_gq):
    """One cluster in loops and numpy: fpm[s, w], windows (chrom, st, en), samples to call, samples to fit with."""
    pooled = [*own, *fit]
    noise = fpm[np.ix_(pooled, np.flatnonzero(kind == 2))]
    sd0 = np.sqrt((noise**2).mean())
    sd0 += sd0 / (4 * noise.size)
    zero = sd0 * fn.HALF_NORMAL_95
    called = []
    for w in np.flatnonzero(kind != 2):
        x = fpm[pooled, w]
        if np.median(x) <= zero or (f := plain_fit(x)) is None:
            continue
        mu, sd = f
        if (np.abs(x - mu) < 2 * sd).sum() < 0.5 * len(x) or mu - 2 * sd <= zero:
            continue
        called.append((w, mu, sd, 0 if haploid or mu / 2 - sd > zero else 1))
    lik = np.zeros((len(own), len(called), 4))
    for j, (w, mu, sd, code) in enumerate(called):
        x = fpm[own, w]
        lik[:, j, 0] = 2 * pdf(x, 0, sd0)
        lik[:, j, 1] = 0 if haploid or code else pdf(x, mu / 2, sd / 2)
        lik[:, j, 2] = pdf(x, mu, sd)
        y = x - mu - 2 * sd
        with np.errstate(invalid="ignore", divide="ignore"):
            lik[:, j, 3] = np.where(y > 0, np.exp(-0.5 * ((np.log(np.where(y > 0, y, 1)) - np.log(mu * (2 if haploid else 1))) / 0.5) ** 2) / (np.where(y > 0, y, 1) * 0.5 * np.sqrt(2 * np.pi)), 0)
    prior, seen = np.ones(4), None
    for _ in range(20):
        n = np.bincount((lik * prior).argmax(2).ravel(), minlength=4) + 1
        prior = n / n.sum()
        if seen == (seen := [f"{p:.2e}" for p in prior]):
            break
    state = (lik * prior).argmax(2)
    where = [wins[w] for w, *_ in called]
    gaps = [b[1] - a[2] for a, b in zip(where, where[1:]) if a[0] == b[0]]
    near, dmax = int(np.quantile(gaps, 0.5)), int(np.quantile(gaps, 0.9))
    trans = np.ones((4, 4))
    for s in range(len(own)):
        for j in range(1, len(called)):
            if where[j][0] == where[j - 1][0] and where[j][1] - where[j - 1][2] <= near:
                trans[state[s, j - 1], state[s, j]] += 1
    trans /= trans.sum(1, keepdims=True)
    out = set()
    for s, sample in enumerate(own):
        for chrom in {x[0] for x in where}:
            at = [j for j, x in enumerate(where) if x[0] == chrom]
            for cn, a, z, q in hmm.decode([int(called[j][0]) for j in at], [where[j][1] for j in at], [where[j][2] for j in at], lik[s, at], trans, prior, dmax, min_gq):
                out.add((sample, cn, a, z, round(q, 5)))
    return out


def test_calls_of_clusters_against_loops(spark):
    rng = np.random.default_rng(6)
    n, wins, kind = 30, [], []
    for c, chrom in enumerate(("chr1", "chr2", "chrX")):
        for k in range(24):
            wins.append((chrom, k * 700 + (2500 if k > 12 else 0), k * 700 + (2500 if k > 12 else 0) + 150))
            kind.append(2 if k % 8 == 7 else 1 if c == 2 else 0)
    kind = np.array(kind)
    male = np.arange(n) % 2 == 1
    mean = rng.uniform(300, 900, len(wins))
    counts = rng.normal(mean, mean * 0.04, (n, len(wins)))
    counts[:, kind == 2] = np.abs(rng.normal(0, 3, (n, (kind == 2).sum())))
    counts[np.ix_(male, kind == 1)] /= 2
    counts[3, 2:6] /= 2
    counts[4, 30:34] *= 1.6
    counts[5, 50:54] = rng.random(4)
    counts[8, 52:55] /= 2
    counts = np.maximum(np.rint(counts), 0).astype(int)
    cells = spark.createDataFrame([(s, w, *wins[w], int(kind[w]), int(counts[s, w])) for s in range(n) for w in range(len(wins))], "s int, widx long, chrom string, st long, en long, wtype int, n long")
    clusters = spark.createDataFrame([("A_01", "", "", 1), ("A_02", "A_01", "", 1), ("G_01", "", "F", 1), ("G_02", "", "M", 1), ("G_03", "", "M", 0)], "cluster_id string, fit_with string, gender string, valid int")
    of = {"A_01": [s for s in range(n) if s < 20], "A_02": [s for s in range(n) if s >= 20], "G_01": [s for s in range(n) if not male[s]], "G_02": [s for s in range(n) if male[s]], "G_03": [1]}
    members = spark.createDataFrame([(c, s) for c, m in of.items() for s in m], "cluster_id string, s int")
    windows = spark.createDataFrame([(w, *wins[w], int(kind[w])) for w in range(len(wins))], "widx long, chrom string, st long, en long, wtype int")
    found, _ = calling.call(mo.fpm(cells), clusters, members, windows, 3.0)
    got = {}
    for r in found.collect():
        got.setdefault(r.cluster_id, set()).add((r.s, r.cn, r.first_w, r.last_w, round(r.qs, 5)))
    base = np.where(kind[None, :] == 0, counts[:, kind == 0].sum(1, keepdims=True), counts.sum(1, keepdims=True))
    fpm = counts * 1e6 / base
    for c, fit in (("A_01", []), ("A_02", of["A_01"]), ("G_01", []), ("G_02", [])):
        sex = c.startswith("G")
        use = np.where(kind == (1 if sex else 0), 0, np.where(kind == 2, 2, -1))
        keep = np.flatnonzero(use >= 0)
        want = plain_calls(fpm[:, keep], use[keep], [wins[w] for w in keep], of[c], fit, c == "G_02", 3.0)
        assert got.get(c, set()) == {(s, cn, int(keep[a]), int(keep[z]), q) for s, cn, a, z, q in want}
    assert "G_03" not in got
    assert any(x[:2] == (3, 1) for x in got["A_01"]) and any(x[:2] == (5, 0) for x in got["G_02"]) and not any(x[1] == 1 for x in got["G_02"])


def test_linkage_against_plain_search():
    rng = np.random.default_rng(8)
    for n in (2, 3, 9, 40):
        pts = np.round(rng.normal(0, 3, (n, 2)), 1)
        d = {(i, j): float(np.linalg.norm(pts[i] - pts[j])) for i in range(n) for j in range(n) if i < j}
        size, live, want = dict.fromkeys(range(n), 1), list(range(n)), []
        for k in range(n, 2 * n - 1):
            a, b = min(((i, j) for i in live for j in live if i < j), key=lambda p: (d[p], p))
            want.append((a, b, d[a, b], size[a] + size[b]))
            for c in live:
                if c not in (a, b):
                    d[c, k] = (size[a] * d[min(a, c), max(a, c)] + size[b] * d[min(b, c), max(b, c)]) / (size[a] + size[b])
            size[k] = size[a] + size[b]
            live = [c for c in live if c not in (a, b)] + [k]
        assert [t[2:] for t in cl.linkage(pts)] == [pytest.approx(t[2:]) for t in want]


def test_gram_and_components_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(100, 10, (7, 50))
    x[:3] += 40 * rng.random(50)
    cells = spark.createDataFrame([(s, w, float(x[s, w])) for s in range(7) for w in range(50)], "s int, widx long, fpm double").repartition(5)
    c = x - x.mean(0)
    g = {(r.a, r.b): r.g for r in cl.gram(cells).collect()}
    assert all(g[i, j] == pytest.approx((c @ c.T)[i, j]) for i in range(7) for j in range(i, 7))
    u, sv, _ = np.linalg.svd(c, full_matrices=False)
    share = sv**2 / (sv**2).sum()
    got = cl.pca(cells).collect()
    for r in got:
        assert r.share == pytest.approx(share[r.dim]) and abs(r.score) == pytest.approx(abs(u[r.s, r.dim] * sv[r.dim]), abs=1e-6)
    assert 1 <= len({r.dim for r in got}) <= 6
    with pytest.raises(Exception, match="lacks the value"):
        cl.gram(cells.where("not (s = 2 and widx = 3)")).collect()


def test_valid_clusters_by_their_partners(spark):
    c = spark.createDataFrame([("A_01", "", "", 1), ("A_02", "A_01", "", 1), ("A_03", "A_01,A_02,A_04", "", 1), ("A_04", "", "", 1)], "cluster_id string, fit_with string, gender string, valid int")
    m = spark.createDataFrame([(k, i) for k, n in (("A_01", 6), ("A_02", 2), ("A_03", 1), ("A_04", 3)) for i in range(n)], "cluster_id string, s int")
    got = {r.cluster_id: (r.ok, r.fit_with) for r in reuse.valid_clusters(c, m, 6).collect()}
    assert got == {"A_01": (True, ""), "A_04": (False, ""), "A_02": (True, "A_01"), "A_03": (True, "A_01,A_02")}


def test_branch_scores_by_hand():
    # four leaves: (0, 1) at 1, (2, 3) at 2, both at 10
    tree = [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 10.0, 4)]
    z = cl.branch_scores(tree, 4, 2)
    assert z[0] == z[3] == 0.0
    assert z[4] == pytest.approx((9 - 1) / (0 + 1)) and z[5] == pytest.approx((8 - 2) / 1)


def test_quantiles_narrow_down_to_the_exact_value(spark, monkeypatch):
    monkeypatch.setattr(mo, "SORTED", 20)
    monkeypatch.setattr(mo, "BINS", 8)
    rng = np.random.default_rng(12)
    qs = [0.0, 0.2, 0.5, 0.99, 1.0]
    for x in (rng.lognormal(2, 2, 700), np.repeat([1.0, 2.0, 5.0], 100), np.array([3.0]), np.full(50, 7.0), np.concatenate([np.zeros(400), rng.random(9)])):
        got = mo.quantiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "fpm double"), "fpm", qs)
        assert got == pytest.approx(np.quantile(x, qs))
    assert mo.quantiles(spark.createDataFrame([], "fpm double"), "fpm", qs) is None


def test_a_sample_without_breakpoints_is_skipped(spark, tmp_path, caplog):
    bps = spark.createDataFrame([("a", "chr1", 1, 5, "DEL", 3, "x,y,z")], "sample string, chrom string, bp_start long, bp_end long, cnvtype string, n_qnames long, qnames string")
    sinks.write_breakpoints(bps, str(tmp_path / "bp"))
    got = text.read_breakpoints(spark, str(tmp_path / "bp"), ["a", "b"]).collect()
    assert [r["sample"] for r in got] == ["a"] and "no breakpoints of sample b" in caplog.text
