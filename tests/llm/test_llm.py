"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhelix.llm import ann, bpe, linededup, media, mixing, ngram, sharding, tokenfile, toxicity, urlfilter
from tallyhelix.llm.common import Scratch, components, linked, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, comp string, key string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
random.seed(7)
VOCAB = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def changed(text, places):
    w = text.split(" ")
    for p in places:
        w[p] = "changed"
    return " ".join(w)


BASE = prose(120, 1)
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "ONE",
    BASE,
    BASE,
    changed(BASE, [60]),
    changed(BASE, [10]),
    changed(BASE, [5, 30, 55, 80, 105]),
    prose(90, 2) + "\n" + prose(40, 3) + "\n\n" + prose(30, 4),
    prose(90, 5) + "\r\n" + prose(40, 3) + "\n" + changed(prose(30, 4), [29]),
    prose(20_000, 6),
    "x" * 30_000,
    "été ΣΑΣ 漢字 😀 <|endoftext|> It's 'S  42½",
    "a b c d e\x00f",
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", None, "s", "t", "c", "k") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "nobody's text", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "t")
    yield s
    s.drop(s.root)


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def test_components(spark, scratch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (9, 8), (20, 21), (5, 5)], "a long, b long")
    got = {r.id: r.comp for r in components(scratch, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 20: 20, 21: 20}


# --- 1


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def test_lines(spark, scratch):
    long = prose(60, 11)
    near = changed(long, [59])
    rows = [(1, f"{long}\nkeep one\n\nsame line here"), (2, f"Same  LINE, here!\n{long.upper()}\nother"), (3, f"{near}\nlast"), (4, None), (5, ""), (6, "same line here"), (6, "same line here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._lines, r._kept) for r in linededup.dedup(d, scratch).collect()}
    linked = distance(long, near) <= (1 - linededup.SIMILAR) * len(long)
    assert got[1] == (rows[0][1], 4, 4)
    assert got[2] == ("other", 3, 1)
    assert got[3][0] == ("last" if linked else rows[2][1])
    assert got[4] == (None, 0, 0) and got[5][0] == "" and got[6] == ("", 1, 0)


def edited(line, edits, r):
    t = list(line)
    for at in r.sample(range(len(t)), edits):
        t[at] = r.choice(["q", "", t[at] + "z", " "])
    return norm("".join(t))


def test_near_lines_of_any_length_are_found(spark, scratch, monkeypatch):
    monkeypatch.setattr(linededup, "PASS", 40)
    r, base, near = random.Random(12), [], []
    for i in range(240):
        n = (1, 2, 3, 5, 8, 10, 15, 20, 30, 40, 60, 150)[i % 12]
        line = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n)).ljust(10, "x")
        other = edited(line, r.randint(1, max(1, len(line) // 25)), r) if i % 24 < 12 or n < 10 else changed(line, [r.randrange(n)])
        if other and other != line and distance(line, other) <= (1 - linededup.SIMILAR) * max(len(line), len(other)):
            base.append(line)
            near.append(other)
    assert len(near) > 180
    d = spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join(near))], "doc_id long, text string")
    got = {x.doc_id: x._kept for x in linededup.dedup(d, scratch).collect()}
    assert got[1] == len(base) and got[2] == 0


def test_near_lines_without_spaces_are_found(spark, scratch):
    """Long lines of one to four words, with one edit up to as many as the similarity allows, and next to the limits of other kinds of keys."""
    r, base, near = random.Random(13), [], []
    letters = {"han": [chr(c) for c in range(0x4E00, 0x4F00)], "latin": list("abcdefghijklmnopqrstuvwxyz0123456789")}
    for i in range(160):
        own, size, n = letters[("han", "latin")[i % 2]], (38, 41, 44, 45, 46, 50, 60, 100, 300)[i % 9], 1 + i % 4
        line = norm(" ".join("".join(r.choice(own) for _ in range(size // n + 1)) for _ in range(n)))
        other = norm(edited(line, 1 if i % 3 else len(line) // 10, r))
        # edits that make many words of one leave lines of another kind, whose keys are found with a probability
        if other and other != line and len(other.split()) <= n + 1 and distance(line, other) <= (1 - linededup.SIMILAR) * max(len(line), len(other)):
            base.append(line)
            near.append(other)
    assert len(near) > 120
    d = spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join(near))], "doc_id long, text string")
    got = {x.doc_id: x._kept for x in linededup.dedup(d, scratch).collect()}
    assert got[1] == len(base) and got[2] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_recall_against_all_pairs(spark, scratch):
    """Every pair of lines of the least edit similarity, by brute force over the normalised lines of the test data."""
    import duckdb

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split("text", "\n")).alias("t"))
    lines = sorted({norm(r.t) for r in d.collect()} - {""}, key=lambda x: (len(x), x))
    size = np.array([len(x) for x in lines])
    grams = np.zeros((len(lines), 512), np.int32)
    for i, x in enumerate(lines):
        c = np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.int64)
        np.add.at(grams[i], (c[:-1] * 7919 + c[1:] * 104729) % 512, 1)
    some = []
    for i in range(len(lines)):
        last = int(np.searchsorted(size, size[i] / linededup.SIMILAR + 1e-9, "right"))
        # an edit changes two pairs of neighbours in either line
        far = np.abs(grams[i + 1 : last] - grams[i]).sum(1)
        some += [(i, int(j)) for j in np.flatnonzero(far <= 4 * np.floor(size[i + 1 : last] / 10 + 1e-9)) + i + 1]
    con = duckdb.connect()
    con.execute("create table l(i int, t varchar)")
    con.executemany("insert into l values (?, ?)", list(enumerate(lines)))
    con.execute("create table p(a int, b int)")
    con.executemany("insert into p values (?, ?)", some)
    near = con.execute("select a, b from p join l x on x.i = a join l y on y.i = b where levenshtein(x.t, y.t) <= floor(greatest(length(x.t), length(y.t)) / 10 + 1e-9)").fetchall()
    got = linededup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), scratch)
    kept = {r.doc_id for r in got.where("_kept > 0").collect()}
    missed = [p for p in near if kept.issuperset(p)]
    print(f"{len(near)} near pairs, {len(missed)} missed")
    assert len(near) >= 20 and len(missed) <= 0.1 * len(near)


def test_short_lines_are_found_for_certain(spark):
    r, rows = random.Random(13), []
    while len(rows) < 300:
        x = norm("".join(r.choice("abcd ") for _ in range(r.randint(10, linededup.SHORT - 1))))
        y = edited(x, r.randint(1, len(x) // 10), r) if len(x) >= 10 else ""
        longer = max(len(x), len(y))
        if y and longer < linededup.SHORT and distance(x, y) <= longer // 10:
            rows.append((x, y, longer // 10))
    k = spark.createDataFrame(rows, "x string, y string, most int").select("most", linededup.keys(F.col("x")).alias("a"), linededup.keys(F.col("y")).alias("b")).collect()
    low = (1 << linededup.PLACE) - 1
    assert all(any(p >> linededup.PLACE == q >> linededup.PLACE and abs((p & low) - (q & low)) <= v.most for p in v.a for q in v.b) for v in k)


def test_simhash_is_the_majority_of_words(spark):
    texts = ["a b c", "x", prose(70, 3), " ".join(f"w{i}" for i in range(500))]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h"), linededup.simhash(F.col("t")).alias("s")).collect():
        h = set(r.h)
        assert sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2) == r.s & (2**64 - 1)


def test_bags_never_exceed_the_distance(spark):
    rng, rows = random.Random(6), []
    for _ in range(200):
        a = "".join(rng.choice("eaio xé") for _ in range(rng.randint(0, 40)))
        rows.append((a, edited(a, rng.randint(0, len(a)), rng) if a else "ee"))
    rows.append(("e" * 400, "e" * 300 + "a" * 300))
    d = spark.createDataFrame(rows, "x string, y string")
    got = d.select("x", "y", linededup.least_edits(linededup.bag(F.col("x")), linededup.bag(F.col("y"))).alias("n")).collect()
    for r in got:
        cx, cy = (Counter(t) for t in (r.x, r.y))
        low = [{c: min(k[c], 255) for c in linededup.LETTERS} for k in (cx, cy)]
        assert r.n == max(sum(max(a[c] - b[c], 0) for c in a) for a, b in (low, low[::-1]))
        assert r.n <= distance(r.x, r.y)


def test_cut_keeps_the_distance(spark):
    rng, rows = random.Random(5), []
    for _ in range(150):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", "x", "yz"])
        rows.append((a, "".join(b)))
    d = spark.createDataFrame(rows, "x string, y string")
    for r in d.select("x", "y", linededup.let(linededup.cut(F.col("x"), F.col("y")), lambda s: F.levenshtein(s["x"], s["y"])).alias("d")).collect():
        assert r.d == distance(r.x, r.y)


def test_lines_odd(spark, docs, scratch):
    out = linededup.dedup(docs, scratch)
    assert out.columns == [*docs.columns, "_lines", "_kept"]
    rows = out.collect()
    assert len(rows) == docs.count() - 1  # the repeated row comes out once
    kept = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert kept[0] is None and kept[1] == "" and kept[5] == BASE and kept[6] == ""
    assert linededup.dedup(empty(spark), scratch).count() == 0


# --- 2


def test_jpeg_round_trip():
    rng = random.Random(2)
    payloads = [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 3, b"\xff" * 1000, rng.randbytes(100_000)] + [rng.randbytes(rng.randint(0, 300)) for _ in range(60)]
    for p, (im, coef, error) in zip(payloads, media.decode(media.encode(payloads)), strict=True):
        assert error is None
        n, got = media.payload_of(im, coef)
        assert n == len(p) and got == p.ljust(max(1, -(-len(p) // 64)) * 64, b"\0")
        thumb = media.thumbnail(im, coef)
        assert thumb.shape == (im.height // 8, im.width // 8)


def bits_of(values):
    s = "".join(format(c, f"0{n}b") for c, n in values)
    s += "1" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0")


def test_jpeg_of_another_writer():
    """Three components, 2 x 2 sampling, zero runs, ends of block, no restart markers."""
    dc = media.table_of({s: 4 for s in range(12)})
    ac = media.table_of({0x00: 2, 0x01: 2, 0x11: 3, 0xF0: 4, 0x02: 4, 0x21: 5})
    dcc, acc = media.codes_of(*dc), media.codes_of(*ac)
    rng, out, truth, pred = random.Random(3), [], [], [0, 0, 0]

    def bits(v):
        n = abs(v).bit_length()
        return [(v if v > 0 else v + (1 << n) - 1, n)] if n else []

    order = [0, 0, 0, 0, 1, 2]
    for _ in range(4):  # four MCUs of 16 x 16
        for comp in order:
            block = [0] * 64
            block[0] = rng.randint(-200, 200)
            out += [dcc[abs(block[0] - pred[comp]).bit_length()], *bits(block[0] - pred[comp])]
            pred[comp] = block[0]
            block[1], block[3], block[21] = rng.choice([-1, 1]), rng.choice([-1, 1]), rng.choice([-1, 1])
            out += [acc[0x01], *bits(block[1]), acc[0x11], *bits(block[3]), acc[0xF0], acc[0x11], *bits(block[21]), acc[0x00]]
            truth.append((comp, block))
    seg = media._segment
    frame = b"".join(bytes([i + 1, hv, 0]) for i, hv in enumerate((0x22, 0x11, 0x11)))
    raw = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([4] + [1] * 63)) + seg(0xC0, bytes([8, 0, 30, 0, 31, 3]) + frame) + seg(0xC4, b"\0" + dc[0] + dc[1]) + seg(0xC4, b"\x10" + ac[0] + ac[1])
    raw += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bits_of(out) + b"\xff\xd9"
    [(im, coef, error), (none, _, why)] = media.decode([raw, raw[:200]])
    assert error is None and none is None and why
    assert (im.width, im.height, im.mcus) == (31, 30, (2, 2))
    luma = [b for c, b in truth if c == 0]
    for m in range(4):
        for k in range(4):
            y, x = m // 2 * 2 + k // 2, m % 2 * 2 + k % 2
            assert coef[y * 4 + x].tolist() == luma[m * 4 + k]
    thumb = media.thumbnail(im, coef)
    assert thumb[0, 0] == min(255, max(0, luma[0][0] * 4 // 8 + 128))


def test_jpeg_query(spark, docs):
    got = {r.doc_id: r for r in media.jpeg_features(media.to_jpeg(docs)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), None)
    bad = spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")
    assert {r.doc_id: (r.feature, bool(r.error)) for r in media.jpeg_features(bad).collect()} == {1: (None, True), 2: (None, True)}
    assert media.jpeg_features(media.to_jpeg(empty(spark))).count() == 0


# --- 3


def groups(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def test_jaccard_components(spark, scratch):
    texts = list(TEXTS)
    for k in range(12):  # a chain: ends of which are far apart, and a crowd of near copies
        texts.append(changed(prose(100, 50), range(0, 3 * k, 3)))
    texts += [changed(prose(80, 51), [k]) for k in range(30)] + ["a b c d e f", "A b c d e f", "a b c d e g"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram.component_ids(d, scratch).collect()}
    assert got == groups(texts)


def test_jaccard_counts_every_link(spark, scratch):
    texts = [*TEXTS, *[changed(prose(100, 50), range(0, 3 * k, 3)) for k in range(12)], *[changed(prose(80, 51), [k]) for k in range(30)], prose(80, 51), prose(80, 51)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))} for w in (re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) for t in texts)]
    want = {i: sum(j != i and bool(x and y) and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = ngram.component_ids(d, scratch).collect()
    assert {r.doc_id: r.n_links for r in rows} == want and max(want.values()) >= 31
    few = ngram.component_ids(d, scratch, links=False)
    assert "n_links" not in few.columns and {r.doc_id: r.component_id for r in few.collect()} == {r.doc_id: r.component_id for r in rows}


def test_links_over_many_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(ngram, "MEMBERS", 6)
    monkeypatch.setattr(ngram, "COLUMNS", 16)
    texts = [changed(prose(90, 60), random.Random(k).sample(range(90), k % 4)) for k in range(40)] + [prose(90, 61), changed(prose(90, 61), [4]), prose(50, 62)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    want = {i: sum(j != i and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_links for r in ngram.component_ids(d, scratch).collect()} == want
    assert 0 in want.values() and max(want.values()) > 20


def test_jaccard_odd(spark, docs, scratch):
    rows = ngram.component_ids(docs, scratch).collect()
    assert len(rows) == docs.count()
    assert all(r.component_id == 5 for r in rows if r.doc_id in (5, 6, 7, 8))
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    assert ngram.component_ids(empty(spark), scratch).count() == 0


# --- 4


def test_rules_and_propagation(spark, scratch):
    link = lambda *h: "".join(f'<a href="https://{x}/p">x</a><a href="/own">y</a>' for x in h)
    rows = [
        (1, "https://A.Example.NET/en/1?x#y", link("good.io")),
        (2, "http://a.example.net/de/1", None),
        (3, "http://x.org/fr/2", link("fine.io", "fine.io")),
        (4, "http://example.com/de", ""),
        (5, "http://example.com/de/", ""),
        (6, "http://farm.io/?http://x.org", link("bad.net", "bad.net", "example.com")),
        (7, "http://bad.net/z", link("farm.io")),
        (8, "http://good.io", link("fine.io")),
        (9, None, link("bad.net")),
        (10, "no scheme", None),
        (11, "http://net", None),
        (7, "http://bad.net/z", link("farm.io")),
    ]
    got = defaultdict(list)
    for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("good", F.lit(2)), scratch).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.example.net", "/en/1", "example.net/en/", "allow")]
    assert got[2] == [("a.example.net", "/de/1", "net/", "block")]
    assert got[3][0][2:] == ("org/fr/", "allow") and got[4][0][2] is None and got[5][0][2:] == ("example.com/de/", "block")
    assert got[6] == [("farm.io", "/", None, "block")]
    assert len(got[7]) == 2 and got[8][0][3] == "allow"
    assert got[9] == [("", "", None, "allow")] and got[10] == [("", "", None, "allow")] and got[11][0][:3] == ("net", "", None)
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string"), scratch).count() == 0


def test_distrust_reaches_the_end_of_a_long_chain(spark, scratch):
    n = 24  # h0 is blocked by rule; each host links to the one before
    rows = [(0, "http://h0.net/", "")] + [(i, f"http://h{i}.io/", f'<a href="https://h{i - 1}.{"net" if i == 1 else "io"}/">x</a>') for i in range(1, n)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}
    want = [0.15 * 0.85**i for i in range(n)]
    assert all(abs(got[i].distrust - want[i]) < 1e-4 * 0.5 / n + 1e-11 * n for i in range(n))
    assert [got[i].verdict for i in range(1, n)] == ["block" if want[i] >= 0.5 / n else "allow" for i in range(1, n)]
    assert got[9].verdict == "block"


def test_scores_of_a_loop_settle(spark, scratch):
    rows = [(1, "http://a.net/", '<a href="//b.io/">x</a>'), (2, "http://b.io/", '<a href="//a.net/">x</a>')]
    got = {r.page_id: r.distrust for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}
    assert got[1] == pytest.approx(0.15 / (1 - 0.85**2), abs=2e-3) and got[2] == pytest.approx(0.85 * got[1], abs=2e-3)


# --- 5


def toxic_set(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = prose(150, 1000 + i)
        if bad:
            t = changed(t, []) + " " + " ".join(random.Random(i).choice(["vileword", "hatefulx", "nastystem" + VOCAB[i % 9]]) for _ in range(5))
        rows.append((i, t, "s"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), {i: b for i, b in labels}


def test_toxicity_held_out(spark, scratch):
    ship(spark)
    docs, labels, truth = toxic_set(spark)
    rows = toxicity.score(docs, toxicity.learn(spark, docs, labels, scratch)).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_ignores_held_out_labels(spark, scratch):
    docs, labels, _ = toxic_set(spark, 150)
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(spark, docs, x, scratch)).collect()} for x in (labels, wrong))
    assert a == b


def symbols(word):
    """(context, event) of every byte and the end of a word."""
    w = bytes([toxicity.BEGIN]) + word + bytes([toxicity.END])
    return [(w[max(0, i - toxicity.CONTEXT) : i], w[i]) for i in range(1, len(w))]


def as_number(context, event):
    return sum(b << (8 * j) for j, b in enumerate(reversed(context), 1)) | event


def test_every_byte_is_an_event():
    texts = [b"abcdefghijkl xy", "漢字漢字漢字".encode(), b"x" * 5000, b"Zcdefghijk"]
    kind, start, end, _ = toxicity.words_at(texts, toxicity.letter_bytes())
    got = defaultdict(list)
    for w, c in zip(*(x.tolist() for x in toxicity.events(kind, start, end)), strict=True):
        got[w].append(c)
    for w, word in enumerate([b"abcdefghijkl", b"xy", texts[1], texts[2], b"zcdefghijk"]):
        assert got[w] == [as_number(*e) for e in symbols(word)]
    assert got[0][9:11] == got[4][8:10]  # j, k after the same six bytes, at other places of their words


def plain_kneser_ney(counts):
    """event -> log ratio of both classes, by the formulas, with dictionaries; counts: (context, event) -> (ordinary, toxic)."""
    d, ds, m = toxicity.DISCOUNT, toxicity.SHARED_DISCOUNT, toxicity.CONTEXT
    kinds = [set() for _ in range(m)]
    longer = set(counts)
    times = []
    for k in range(m - 1, -1, -1):
        n = Counter((c[len(c) - k :] if len(c) > k else c, e) for c, e in longer)
        times.append((k, n))
        longer = set(n)
    assert len(kinds) == len(times)

    def lower(c, e, k):
        if k < 0:
            return 1 / 256
        n = dict(times)[k]
        c = c[len(c) - k :] if len(c) > k else c
        same = {x: v for (y, x), v in n.items() if y == c}
        return (max(same[e] - ds, 0) + ds * len(same) * lower(c, e, k - 1)) / sum(same.values())

    out = {}
    for c, e in counts:
        same = {x: v for (y, x), v in counts.items() if y == c}

        def over(n, base, off):
            total = sum(n.values())
            left = 1 - sum(max(v - off, 0) for v in n.values()) / max(total, 1)
            return max(n[e] - off, 0) / max(total, 1) + left * base

        pooled = over({x: v[0] + v[1] for x, v in same.items()}, lower(c, e, m - 1), ds)
        out[c, e] = np.log(over({x: v[1] for x, v in same.items()}, pooled, d) / over({x: v[0] for x, v in same.items()}, pooled, d))
    return out


def test_models_against_plain_kneser_ney():
    r = random.Random(21)
    counts = defaultdict(lambda: [0, 0])
    for _ in range(500):
        y = int(r.random() < 0.3)
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 9))) if r.random() < 0.6 or not y else "bad" + r.choice("abc") * r.randint(0, 6)
        for e in symbols(word.encode()):
            counts[e][y] += 1
    want = plain_kneser_ney(counts)
    rows = sorted((as_number(*k), *v) for k, v in counts.items())
    code, ordinary, toxic = (np.array(x) for x in zip(*rows, strict=True))
    keys, ratio = toxicity.fit(code, toxicity.shared_lower(code), ordinary, toxic)
    got = dict(zip(keys.tolist(), ratio.tolist(), strict=True))
    assert all(got.get(as_number(*k), 0.0) == pytest.approx(v, abs=1e-12) for k, v in want.items())
    # a document: each word by the mixture, ordinary words and unknown ones included
    text = "bada abcabc badbadbad zzz ca"
    total, n = toxicity.evidence([text, None, ""], (keys, ratio))
    per = [sum(want.get(e, 0.0) for e in symbols(w.encode())) for w in text.split()]
    assert total[0] == pytest.approx(sum(np.log(1 - toxicity.SHARE + toxicity.SHARE * np.exp(x)) for x in per)) and total[1] == total[2] == 0 and n.tolist() == [5, 0, 0]


def test_toxicity_after_the_seventh_byte(spark, scratch):
    ship(spark)
    rows = [(i, prose(150, 1000 + i) + " " + " ".join(["ordinaryquxvile" if i % 4 == 0 else "ordinarywords"] * 5)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    held = [r for r in toxicity.score(d, toxicity.learn(spark, d, labels, scratch)).collect() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97


def test_rare_events_are_counted(spark):
    ship(spark)
    sample = spark.createDataFrame([(0, 0, "one two"), (1, 1, "one three")], "y int, part int, text string")
    got = toxicity._sample_counts(sample).collect()
    # the end of a word is an event; "two" and "three" share their first
    assert len(got) == 4 + 4 + 5 and sum(r.c0 for r in got) == 8 and sum(r.c3 for r in got) == 10


def test_toxicity_odd(spark, docs, scratch):
    assert {r.score for r in toxicity.score(docs, toxicity.learn(spark, docs, empty(spark, "doc_id long, toxic int"), scratch)).collect()} == {0.0}
    train, labels, _ = toxic_set(spark, 100)
    learned = toxicity.learn(spark, train, labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")), scratch)
    rows = toxicity.score(docs, learned).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(empty(spark), learned).count() == 0


# --- 6


def test_token_packing():
    rng = np.random.default_rng(0)
    for v in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32), rng.integers(0, 2**32, 1001).astype(np.uint32), rng.integers(0, 300, 1003).astype(np.uint32)):
        control, data = tokenfile.pack(v)
        assert (tokenfile.unpack(control, data, len(v)) == v).all()
    ids = [np.array(x, "<u4").tobytes() for x in ([5, 5, 5, 70000], [], [9])]
    keys, per, flat = tokenfile.read_file(tokenfile.file_bytes([7, None, 9], ids))
    assert keys == [7, None, 9] and per.tolist() == [4, 0, 1] and flat.tolist() == [5, 5, 5, 70000, 9]


def test_token_files(spark, docs, scratch, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenfile.TOKENIZER))
    folder = scratch.path("files")
    files = scratch.table(tokenfile.write_tokens(docs, folder), "written")
    rows = tokenfile.read_tokens(files, folder, with_ids=True).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:]) and len(rows) == docs.count()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            want = np.array(t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
            assert bytes(r.token_ids) == want and r.ids_crc32 == zlib.crc32(want) and r.n_tokens == len(want) // 4
    folder = scratch.path("none")
    assert tokenfile.read_tokens(scratch.table(tokenfile.write_tokens(empty(spark), folder)), folder).count() == 0


# --- 7


def fill(sizes, weights):
    """Targets by plain rounds of sharing out the excess."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        share = {s: rest * weights[s] / w for s in sizes if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark, scratch):
    rows = [(i, prose(random.Random(i).randint(1, 60), i), f"s{random.Random(i).choice([0, 0, 0, 0, 1, 2, 3])}") for i in range(1500)]
    rows += [(5000, "tiny source", "s9"), (5001, None, None), (5002, "b c d", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(d, scratch).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want = fill(dict(sizes), weights)
    taken, spread = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        part = r.target / r.source_size % 1
        spread[r.source] += r.size**2 * part * (1 - part)
    assert all(abs(taken[s] - want[s]) <= 4 * spread[s] ** 0.5 + 1e-6 for s in sizes)
    assert Counter(r.doc_id for r in mixing.mix(d, scratch).collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_odd(spark, docs, scratch):
    plan = mixing.mix_plan(docs, scratch).collect()
    assert len(plan) == docs.count() and mixing.mix(docs, scratch).columns == docs.columns
    assert mixing.mix_plan(empty(spark), scratch).count() == 0 and mixing.mix(empty(spark), scratch).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.copies) for r in mixing.mix_plan(none, scratch).collect()} == {(0, 0.0, 0)}


# --- 8


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4099])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted("id", n)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != list(range(n))


def test_sharding(spark, docs, scratch):
    rows = sharding.shard(docs, scratch, 4).collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(count.values()) - min(count[s] for s in range(4)) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    for r in rows:
        if r.doc_id is not None:
            raw = (TEXTS[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    again = sharding.shard(docs.repartition(5), scratch, 4).collect()
    key = lambda rs: sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(rows) == key(again)
    assert sharding.shard(empty(spark), scratch).count() == 0


# --- 9


def test_bpe_is_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    m = bpe.model(bpe.TOKENIZER)
    rng = random.Random(1)
    texts = [x or "" for x in TEXTS] + ["", "  ", "it's they'll 'S don’t", "<|endoftext|>a <|startoftext|>", "İstanbul ﬁ ①② \x1c\x85\xa0x", "hahaha" * 90]
    texts += ["".join(rng.choice("abcdeéß \n.'!1") for _ in range(rng.randint(1, 80))) for _ in range(600)]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(1, 0xD7FF), rng.randint(32, 126)])) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    for x, (ids, decoded) in zip(texts, m.encode_texts(texts), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == t.decode(want, skip_special_tokens=False) == m.decode(ids)


def test_bpe_short_and_long_agree():
    m = bpe.model(bpe.TOKENIZER)
    words = [w for w in VOCAB] + ["internationalization", "zzzzzz", "é", "aaaaaaaa"]
    syms = [m.symbols(w) for w in words]
    assert m.encode_short(syms) == [m.encode_long(s) for s in syms]


def test_bpe_query(spark, docs):
    rows = bpe.digests(docs).collect()
    assert len(rows) == docs.count()
    assert next(r for r in rows if r.doc_id == 0).n_tokens == 0
    out = bpe.encode(docs)
    assert {"doc_id", "size", "n_tokens", "token_ids", "decoded"} <= set(out.columns) and out.count() == docs.count()
    assert bpe.digests(empty(spark)).count() == 0


# --- 10


def test_nearest(spark, scratch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)]
    x[700:900] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2050, [0.0] * 16), (2051, [float("nan")] + [1.0] * 15), (2052, [float("inf")] + [1.0] * 15), (2053, [1.0] * 3), (2054, [None] + [1.0] * 15), rows[50], (None, rows[1][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("x"))
    got = defaultdict(list)
    for r in ann.nearest(d, scratch).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = [i for i in range(1500) if i % 50 == 0]
    assert sorted(got) == asked
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in asked:
        s = np.round(u @ u[q], 12)
        s[q] = -2
        best = np.lexsort((np.arange(1500), -s))[:5]
        hits += len({v for _, v, _ in got[q]} & set(best.tolist()))
        assert [k for k, *_ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(sc - u[v] @ u[q]) < 1e-9 for _, v, sc in got[q])
    assert hits >= 0.9 * 5 * len(asked)
    assert [v for _, v, _ in got[0]] == [700, 701, 702, 703, 704]  # ties: the smaller ids
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), scratch).collect()
    assert sorted((r["rank"], r.query_id) for r in few) == [(1, 0), (2, 0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


def test_neighbours_widen_until_enough(spark, scratch, monkeypatch):
    monkeypatch.setattr(ann, "RECALL", 0.0)
    monkeypatch.setattr(ann, "LEAF", 2)
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(0, 1, (60, 6)) * 0.01 + c for c in rng.normal(0, 1, (8, 6)) * 5] + [rng.normal(0, 1, (3, 6)) * 9])
    rows = [(i * 25, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect()
    per = Counter(r.query_id for r in got)
    assert set(per) == {i for i, _ in rows if i % 50 == 0} and set(per.values()) == {5}


# --- pipeline

#: Every name that a stage works with, as an extra column.
CLASH = "id row at line gone keep keys key norm sim len comp home sig n first text_ before after _before own score _score of rate copy _rate _copy _source size grp block part n_tokens token_ids decoded decoded_sha256 component_id n_shingles lines kept _lines _kept doc v".split()


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "bpe"])
def test_stages_keep_any_columns_and_rows(spark, scratch, tmp_path, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = [f"x{i}" for i in range(len(CLASH))]
    base = prose(60, 70)
    rows = [(1, base, "en", "a", 1), (1, base, "de", "a", 1), (2, changed(base, [30]), "en", None, 1), (2, prose(60, 71), "en", "a", 1), (3, None, None, None, None), (None, "nobody's own words here", "en", "b", 1), (4, "", "en", "b", 0)]
    rows += [rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    d = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    out = stage(spark, d, str(tmp_path))
    got = out.collect()
    if name != "bpe":
        assert out.columns == d.columns and all(list(r[5:]) == extra for r in got)
    else:
        assert [c for c in d.columns if c != "text"] == out.columns[: len(d.columns) - 1] and out.columns[-3:] == ["_n_tokens", "_token_ids", "_decoded_sha256"]
        assert len(got) == len(rows)
    if name == "toxicity":
        assert len(got) == len(rows)
    if name == "line_dedup":
        # the near copy, the row in another language and the equal row lose their only line
        assert sorted((str(r.doc_id), r.text is None) for r in got) == [("1", False), ("2", False), ("3", True), ("4", False), ("None", False)]
    if name == "ngram_jaccard":
        assert sorted((str(r.doc_id), r.lang or "") for r in got) in ([("1", x), ("2", "en"), ("3", ""), ("4", "en"), ("None", "en")] for x in ("en", "de"))
    assert stage(spark, d.limit(0), str(tmp_path)).count() == 0



@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline(spark, scratch):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.table(stage(spark, docs, sf), name)
        before, after = docs.collect(), out.collect()
        assert after
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "toxicity":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "line_dedup":
            lines = Counter(norm(x) for r in after for x in (r.text or "").split("\n") if norm(x))
            assert set(lines.values()) <= {1} and all(r.n_chars == len(r.text) for r in after if r.text is not None)
        if name == "ngram_jaccard":
            ids = [r.doc_id for r in before]
            g = groups([r.text for r in before])
            first = {}
            for k, i_ in enumerate(ids):
                first[g[k][1]] = min(i_, first.get(g[k][1], i_))
            assert sorted(r.doc_id for r in after) == sorted(i_ for k, i_ in enumerate(ids) if first[g[k][1]] == i_)
        if name == "mixing":
            copies = Counter(r.doc_id for r in after)
            assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in before}
        if name == "bpe":
            m = bpe.model(bpe.TOKENIZER)
            texts = {r.doc_id: r.text for r in before}
            for r in after:
                ids, decoded = m.encode_texts([texts[r.doc_id]])[0]
                assert bytes(r.token_ids) == ids and r.decoded_sha256 == hashlib.sha256(decoded).hexdigest()
        docs = out


def test_toxicity_learns_from_every_labelled_row(spark, tmp_path):
    ship(spark)
    # more rows than the model took before, and one rare word that only a few of them have
    n = 27_000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.when(F.col("id") % 4 == 0, F.lit(" vile")).otherwise(F.lit(" fair"))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    seen = {}

    def counts(sample):
        seen["counts"] = real(sample)
        return seen["counts"]

    real, toxicity._sample_counts = toxicity._sample_counts, counts
    try:
        (keys, ratio), _ = toxicity.learn(spark, d, labels, Scratch(spark, "all"))
    finally:
        toxicity._sample_counts = real
    cells = seen["counts"].agg(*[F.sum(f"c{i}") for i in range(2 * toxicity.FOLDS)]).first()
    train = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = sum(i % 4 == 0 for i in train)
    assert sum(cells[1::2]) == 10 * toxic and sum(cells[0::2]) == 10 * (len(train) - toxic) and len(keys) == len(ratio) > 0


def test_toxicity_joins_give_the_shared_distribution(spark):
    ship(spark)
    r = random.Random(5)
    rows = [(i % 2, i % 5, " ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 11))) for _ in range(20))) for i in range(60)]
    scratch = Scratch(spark, "lower")
    counts = scratch.table(toxicity._sample_counts(spark.createDataFrame(rows, "y int, part int, text string")), "counts")
    t = counts.orderBy("code").toPandas()
    code, lower = t["code"].to_numpy(), toxicity.shared_lower(t["code"].to_numpy())
    got = {x.low: x.lower for x in toxicity._shared_lower(counts, scratch).collect()}
    assert [got[c & ((1 << 48) - 1)] for c in code.tolist()] == pytest.approx(lower.tolist())
    even, odd = (t[[f"c{2 * k + y}" for k in range(5)]].sum(axis=1).to_numpy() for y in (0, 1))
    want = dict(zip(*(x.tolist() for x in toxicity.fit(code, lower, even, odd)), strict=True))
    keys, ratio, others = toxicity._fitted(counts, scratch)
    assert {k: v for k, v in zip(keys.tolist(), ratio.tolist(), strict=True) if v} == pytest.approx(want) and others.shape == (len(keys), 5)


def test_lines_that_share_an_end_or_none_are_compared_alike(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    pairs = []
    for _ in range(300):
        x = " ".join(word() for _ in range(r.randint(1, 40)))
        y = list(x)
        for _ in range(r.randint(0, max(1, len(x) // 6))):
            y.insert(r.randint(0, len(y)), r.choice("abc")) if r.random() < 0.5 or not y else y.pop(r.randrange(len(y)))
        pairs.append((x, "".join(y)))
    d = spark.createDataFrame(pairs + [("", ""), ("", "a"), ("a" * 30, "a" * 33), ("z" * 300, "a" * 300)], "x string, y string")
    most = F.floor(F.greatest(F.length("x"), F.length("y")) / 10).cast("int")
    bags = [[F.get(linededup.bag(F.col(c)), i) for i in (0, 1)] for c in ("x", "y")]
    rows = d.select(linededup.similar(F.col("x"), F.col("y"), most).alias("got"), (F.levenshtein("x", "y") <= most).alias("want"), (linededup.least_edits(*bags) <= most).alias("may")).collect()
    assert all(x.got == x.want and (x.may or not x.want) for x in rows) and len({x.want for x in rows}) == 2


def test_unlike_lines_of_one_key_are_no_rows(spark, tmp_path, monkeypatch):
    """Lines that share a run of words only are told apart where they meet; near ones among them are found."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 9)))
    lines = [" ".join([word() for _ in range(20)] + ["one run of words"] + [word() for _ in range(20)]) for _ in range(60)]
    lines += [x[:100] + "q" + x[104:] for x in lines[:10]]
    seen, near = [], linededup.near
    monkeypatch.setattr(linededup, "near", lambda pairs, *more: seen.append(pairs.count()) or near(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x._kept for x in linededup.dedup(docs, Scratch(spark, "t")).collect()}
    assert got == {i: int(i < 60) for i in range(70)}
    assert 10 <= sum(seen) < 100


def test_ends_of_near_lines_are_like(spark):
    r, rows = random.Random(13), []
    for _ in range(300):
        x = "".join(r.choice("abcdef é") for _ in range(r.randint(41, 200)))
        at, most, y = r.randint(0, 8) / 8, len(x) // 10, list(x)
        for _ in range(r.randint(most // 2, most)):  # edits are anywhere or crowd in one place
            k = r.randint(0, len(y) - 1) if r.random() < 0.3 else int(at * (len(y) - 1))
            r.choice([lambda: y.pop(k), lambda: y.insert(k, "x"), lambda: y.__setitem__(k, "z")])()
        rows.append((x, "".join(y)))
    rows += [("".join(r.choice("abcdef é") for _ in range(150)), "".join(r.choice("abcdef é") for _ in range(150))) for _ in range(50)]
    d = spark.createDataFrame(rows, "x string, y string").withColumn("most", linededup.edits(F.length("x"), F.length("y")))
    got = d.select(linededup.end_is_like(F.col("x"), F.col("y"), F.col("most")).alias("may"), (F.levenshtein("x", "y") <= F.col("most")).alias("near")).collect()
    assert all(g.may or not g.near for g in got) and sum(g.near for g in got) > 100 and sum(not g.may for g in got) > 30


@pytest.mark.parametrize("dense", [ngram.DENSE, 0])
def test_a_crowd_of_near_copies_is_no_rows_of_pairs(spark, scratch, monkeypatch, dense):
    """Copies that are less like each other than the threshold meet in blocks, and by rows where blocks are ruled out; the links are the same."""
    monkeypatch.setattr(ngram, "DENSE", dense)
    texts = [changed(prose(120, 70), random.Random(k).sample(range(120), 4 + k % 9)) for k in range(150)] + [prose(60, 71), "", "one two", "one two"]
    seen, overlaps = [], ngram.overlaps
    monkeypatch.setattr(ngram, "overlaps", lambda pairs, segs, low, high: seen.append(pairs.count() if low == 0 else 0) or overlaps(pairs, segs, low, high))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = groups(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram.component_ids(d, scratch, links=False).collect()} == want
    assert len({c for _, c in want.values()}) > 30
    if dense:
        assert sum(seen) < 10 * len(texts)


def test_crowds_of_one_key_meet_leaders_before_each_other(spark, scratch):
    """Crowds of links: other leaders connect what the first ones do not, and what is left is as connected as all pairs make it, wherever ``fits`` depends on the posting."""
    r = random.Random(14)
    at = {i: r.random() for i in range(300)}
    rows = sorted({(r.randrange(30), i, r.choice([0, 0, 0, 1, 9])) for i in at for _ in range(12)})
    rows = list({(k, i): (k, i, p) for k, i, p in rows}.values()) + [(100, 900, 0), (100, 901, 0), (101, 900, 0), (101, 901, 0), (102, 902, 1), (102, 903, 9)]
    at |= {900: 5.0, 901: 5.01, 902: 6.0, 903: 6.01}
    values = spark.createDataFrame(list(at.items()), "id long, v double").cache()
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        both = pairs.join(values.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(values.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
        return both.where("abs(x - y) <= 0.1").select("a", "b")

    up = {i: i for i in at}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i, p in rows:
        for k2, j, q in rows:
            if k == k2 and i < j and abs(p - q) <= 1 and abs(at[i] - at[j]) <= 0.1:
                up[max(top(i), top(j))] = min(top(i), top(j))
    postings = spark.createDataFrame(rows, "key long, id long, pos int")
    got = {x.id: x.comp for x in linked(scratch, postings, verify, "abs(x.pos - y.pos) <= 1", alike="pos = 0").collect()}
    assert {i: got.get(i, i) for i in at} == {i: top(i) for i in at} and got[901] == 900 and 902 not in got
    assert sum(seen) < 8000, seen
