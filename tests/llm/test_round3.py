"""Operators 11 to 13 against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhelix.llm import divergence, quality, vectorcode
from tallyhelix.llm.common import Scratch, ship

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, n string, value string, rank string, part string, item string"
EXTRA = (1, "t", "n", "v", "r", "p", "i")


def docs_of(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, lang, s, *EXTRA) for i, (t, lang, s) in enumerate(rows)], DOCS)


# --- 13: divergence


def plain_divergence(rows, ranks=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [((lang or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t, lang, s in rows]
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, s, w in words:
        df[lang].update(set(w))
        groups[lang, s].update(w)
    kept = {lang: {t for t, k in df[lang].items() if k >= 3} for lang in df}
    totals = defaultdict(Counter)
    for (lang, _), c in groups.items():
        totals[lang].update(c)

    def p(c, lang):
        own = {t: c[t] for t in kept[lang]}
        n, v = sum(own.values()), len(own)
        return {t: 1 + 10**9 * (k + 1) // (n + v) for t, k in own.items()}

    f = lambda a, b: (a - b) * (a - b) // b
    out = []
    for lang, s in groups:
        mine, whole = p(groups[lang, s], lang), p(totals[lang], lang)
        pairs = [(o, sum(f(mine[t], q) for t, q in p(groups[lang, o], lang).items())) for k, o in groups if k == lang and o != s]
        likely = [(t, f(mine[t], whole[t])) for t in kept[lang] if groups[lang, s][t] > 0 and mine[t] > whole[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", likely, ranks)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def got_divergence(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def odd_rows():
    rng = np.random.default_rng(1)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "été", "漢字", "ÉTÉ", "x" * 3000]
    rows = []
    for i in range(120):
        lang, source = [("en", "a"), ("en", "b"), ("en", None), ("de", "a"), (None, "z"), ("fr", "only")][i % 6]
        t = " ".join(rng.choice(vocab[: 30 + 15 * (i % 6)], 40)).upper() if i % 4 else "0-9, _ ".join(rng.choice(vocab, 25))
        rows.append((t, lang, source))
    return [*rows, (None, "en", "empty"), ("", "en", "empty"), ("!!! 123", "xx", "none"), ("rare words here", "xx", "other"), rows[0], rows[0]]


def test_divergence_against_plain_counting(spark):
    rows = odd_rows()
    assert got_divergence(divergence.divergence(docs_of(spark, rows), Scratch(spark, "t"))) == plain_divergence(rows)


def test_divergence_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "RANKS", 7)
    rows = odd_rows()
    assert got_divergence(divergence.divergence(docs_of(spark, rows), Scratch(spark, "t"))) == plain_divergence(rows, 7)
    text = ("Ab cd-EF " * 1000 + "g" * 200).encode()
    monkeypatch.setattr(divergence, "AT_ONCE", 100)
    assert [w for part in divergence.terms(text) for w in part] == text.lower().replace(b"-", b" ").split()


def test_divergence_of_an_empty_table(spark):
    assert got_divergence(divergence.divergence(docs_of(spark, []), Scratch(spark, "t"))) == []


@pytest.mark.parametrize("local", [1, 5, 256])
def test_radix_selection_against_sorting(spark, local):
    rng = np.random.default_rng(2)
    rows = []
    for g, n in (("a", 700), ("b", 3), ("c", 400), ("d", 300)):
        items = [f"{chr(97 + i % 3)}{'é' if i % 5 == 0 else ''}{i}" for i in range(n)]
        values = {"a": rng.integers(0, 10**18, n), "b": np.array([5, 5, 0]), "c": rng.integers(0, 3, n), "d": np.full(n, 10**18)}[g]
        rows += [(g, i, int(v)) for i, v in zip(items, values, strict=True)]
    s = Scratch(spark, "top")
    table = s.table(spark.createDataFrame(rows, "g string, item string, value long"))
    for k in (1, 20, 350):
        got = sorted((r.g, r["rank"], r.item, r.value) for r in divergence.top(table, ["g"], k, s, local).collect())
        want = []
        for g in "abcd":
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
            want += [(g, i, r[1], r[2]) for i, r in enumerate(own, 1)]
        assert got == sorted(want)


def test_shares_are_exact_beyond_longs(spark):
    rows = [(0, 1), (5, 7), (8_999_999_999, 10**10), (9_000_000_001, 10**13 + 7), (4 * 10**17, 9 * 10**17)]
    got = spark.createDataFrame(rows, "n long, total long").select("n", "total", divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.total for r in got)


# --- 12: vector codes


def plain_codes(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    x = [[int(np.floor(4096 * float(c))) for c in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    parts = [[r[k * width : (k + 1) * width] for k in range(8)] for r in x]
    books = [[parts[i][k] for i in range(min(16, len(parts)))] for k in range(8)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[k])), key=lambda e: (far(r[k], books[k][e]), e)) for k in range(8)] for r in parts]
    for _ in range(6):
        index = assign()
        for k in range(8):
            for e in range(len(books[k])):
                own = [parts[i][k] for i in range(len(parts)) if index[i][k] == e]
                if own:
                    books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    index = assign()
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(far(parts[i][k], books[k][index[i][k]]) for k in range(8)) for i in range(len(parts))]
    label = Counter()
    for (_, _, lab), e in zip(kept, error, strict=True):
        label[lab] += e
    out = [(r[0], "".join(f"{e:02x}" for e in index[i]), error[i], label[r[2]], sha) for i, r in enumerate(kept)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, x string, code string, error string, `_label` string"


def vectors_of(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, "x", "c", "e", "l") for r in rows], VECTORS)


def got_codes(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in np.float32(rng.normal(0, 0.3, 32))], int(i) % 3 if i % 7 else None) for i in rng.permutation(90)]
    rows += [rows[4], (500, rows[4][1], 1), (None, rows[9][1], 2), (501, [0.0] * 32, None), (502, [1.0] * 5, 0), (503, [], 1)]
    rows += [(504, None, 1), (505, [float("nan")] * 32, 1), (506, [None] + [0.0] * 31, 1), (507, [float("inf")] + [0.0] * 31, 1)]
    assert got_codes(vectorcode.compress(vectors_of(spark, rows).repartition(5), Scratch(spark, "t"))) == plain_codes(rows)


def test_codes_with_ties_few_rows_and_none(spark):
    same = [(i, [0.5, -0.25] * 8, None) for i in range(40)]
    steps = [(i, [float(i % 4)] * 16, i % 2) for i in range(30)]
    for rows in (same, steps, same[:3], [(1, [0.1] * 3, 5)]):
        assert got_codes(vectorcode.compress(vectors_of(spark, rows), Scratch(spark, "t"))) == plain_codes(rows)
    assert got_codes(vectorcode.compress(vectors_of(spark, []), Scratch(spark, "t"))) == []
    assert got_codes(vectorcode.compress(vectors_of(spark, [(1, None, 1)]), Scratch(spark, "t"))) == []
    with pytest.raises(Exception, match="too large"):
        vectorcode.compress(vectors_of(spark, [(1, [1e30] * 8, 1)]), Scratch(spark, "t")).collect()


def test_the_tree_finds_the_nearest_with_the_lowest_index():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 16):
        for scale in (1, 3, 1 << 25):
            book = rng.integers(-scale, scale + 1, (n, 8))
            book[n // 2] = book[0]
            x = np.concatenate([rng.integers(-scale, scale + 1, (300, 8)), book, (book[:1] + book[-1:]) // 2])
            d = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(-1)
            index, far = vectorcode.Vantage(book).nearest(x)
            assert index.tolist() == [int(np.flatnonzero(r == r.min())[0]) for r in d] and far.tolist() == [int(r.min()) for r in d]


def test_the_tree_leaves_branches_out(monkeypatch):
    rng = np.random.default_rng(5)
    book, seen = rng.integers(-100_000, 100_000, (16, 2)), [0]
    plain = vectorcode.squared
    tree = vectorcode.Vantage(book)
    monkeypatch.setattr(vectorcode, "squared", lambda x, e: seen.__setitem__(0, seen[0] + len(x)) or plain(x, e))
    tree.nearest(book[rng.integers(0, 16, 1000)] + rng.integers(-50, 50, (1000, 2)))
    assert seen[0] < 12 * 1000


# --- 11: quality


def test_pairs_are_summed_as_squares():
    rng = np.random.default_rng(6)
    m = quality.Machine(3)
    m.bias, m.weight, m.vector = 0.3, rng.normal(size=quality.WIDTH), rng.normal(size=m.vector.shape)
    feature, value, row = np.array([3, 90, 5000, 8195, 7, 8]), rng.normal(size=6), np.array([0, 0, 0, 0, 1, 1])
    z, _ = m.raw(row, feature, value, 3)
    for r in range(3):
        at = np.flatnonzero(row == r)
        want = m.bias + sum(m.weight[feature[i]] * value[i] for i in at) + sum(m.vector[feature[i]] @ m.vector[feature[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert z[r] == pytest.approx(want)


def test_a_machine_learns_what_no_word_says_alone():
    # the class is whether both words or none are there: weights alone can't tell
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 2, (2000, 2))
    row, col = np.nonzero(np.concatenate([rows, np.ones((2000, 1), int)], 1))
    feature, y = np.array([11, 22, 33])[col], (rows[:, 0] == rows[:, 1]).astype(float)
    m = quality.Machine()
    m.fit(row, feature, np.ones(len(row)), y, np.ones(2000))
    assert ((m.score(row, feature, np.ones(len(row)), 2000) >= 0.5) == y).mean() > 0.99


def test_features_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    text = ("Word and Word, 12 \n" * 3000 + "end").encode()
    chars = np.array([5.0])
    whole = quality.vectors([text], chars)
    monkeypatch.setattr(quality, "AT_ONCE", 1000)
    parts = quality.vectors([text], chars)
    assert (whole[1] == parts[1]).all() and np.allclose(whole[2], parts[2], atol=1e-3)
    words = Counter(text.lower().split())
    assert sorted(np.round(whole[2][whole[1] < quality.BUCKETS] * np.sqrt(sum(np.log1p(k) ** 2 for k in words.values())), 6)) == sorted(round(float(np.log1p(k)), 6) for k in words.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_quality_on_rows_that_were_held_out(spark):
    ship(spark)
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in got if r.quality == 1], [r.predicted for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad) and len(bad) >= 10


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \n ", "x" * 3_000_000, "word " * 200_000, *[f"good words number {i} stand here." for i in range(40)], *[f"BAD$$$ {i}%%% JUNK&&&" for i in range(40)]]
    rows = [(i, t, None, None, len(t or ""), *EXTRA[1:]) for i, t in enumerate(texts)] + [(7, "repeated", "en", "s", None, *EXTRA[1:]), (None, "no id", "en", "s", -5, *EXTRA[1:])]
    ship(spark)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 45)) for i in range(5, 85)] + [(5, None), (None, 1)], "doc_id long, quality int")
    machine = quality.learn(docs, labels)
    got = quality.score(docs, machine).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    of = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 7}
    assert of[0].score == of[1].score  # no text is an empty one
    held = [r for r in got if r.held_out and r.doc_id in range(8, 85)]
    assert held and sum(r.predicted == int(r.doc_id < 45) for r in held) >= 0.9 * len(held)
    assert [r.score for r in sorted(quality.score(docs.repartition(7), machine).collect(), key=str)] == [r.score for r in sorted(got, key=str)]
    # without a class, without the column of lengths, and without rows
    one = labels.where("quality = 1")
    assert quality.learn(docs, one) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.drop("n_chars"), machine).count() == len(rows)
    assert quality.learn(docs.limit(0), labels) is None and quality.score(docs.limit(0), machine).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op12_codes", "op13_divergence"])
def test_new_queries_match_their_sql(spark, name):
    from tallyhelix.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


# --- 4 and 7: small flows, and rows without ids


def test_flows_far_below_a_score_add_up(spark):
    from tallyhelix.llm import urlfilter

    n = 400
    edges = [("seed", f"h{i}", 1) for i in range(n)] + [(f"h{i}", "sink", 1) for i in range(n)]
    hosts = [("seed", 1e-10), ("sink", 0.0), *[(f"h{i}", 0.0) for i in range(n)]]
    h, e = spark.createDataFrame(hosts, "host string, bad double"), spark.createDataFrame(edges, "src string, dst string, n long")
    got = {r.host: r.score for r in urlfilter.propagate(Scratch(spark, "t"), h, e, "bad", 1e-11, 22).collect()}
    assert got["sink"] == pytest.approx(1e-10 * 0.15 * 0.85**2, rel=1e-6) and got["h0"] == pytest.approx(1e-10 * 0.15 * 0.85 / n, rel=1e-6)


def test_propagation_over_links_matches_its_sql(spark, tmp_path):
    from tallyhelix.llm.queries import QUERIES, SQL

    rng = np.random.default_rng(8)
    names = [f"{'www.' if i % 3 else ''}site{i}.{('net', 'org', 'com', 'example.com', 'io')[i % 5]}" for i in range(60)]
    rows = []
    for i in range(300):
        links = " ".join(f'<a href="https://{names[j]}/x">' for j in np.minimum(59, rng.geometric(0.08, rng.integers(0, 6))))
        rows.append((i, f"https://{names[rng.integers(60)]}/{('fr', 'de', 'en')[i % 3]}/{i}", f"<p>{links}</p>"))
    # a chain longer than any fixed few rounds would follow
    rows += [(300 + i, f"http://chain{i}.io/", f'<a href="//chain{i + 1}.io/">') for i in range(30)] + [(330, "http://chain30.io/", '<a href="//bad.net/">'), (331, "http://bad.net/", None), (332, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op4_urls"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(SQL["op4_urls"])
    names_ = [d[0] for d in want.description]
    have = sorted(map(str, (tuple(r[c] for c in names_) for r in got.collect())))
    assert have == sorted(map(str, want.fetchall())) and len({r for r in have if "None, 'block'" in r}) > 3


def test_rows_without_ids_are_mixed_near_their_target(spark):
    from tallyhelix.llm import mixing

    rows = [(None, f"word number {i} of a text", "en", "a", *EXTRA) for i in range(600)] + [(i, "other words here", "en", "b", *EXTRA) for i in range(50)]
    docs = spark.createDataFrame([(r[0], *r[1:4], *EXTRA) for r in rows], DOCS)
    plan = mixing.mix_plan(docs, Scratch(spark, "t")).where("source = 'a'").collect()
    taken = sum(r["size"] * r["copies"] for r in plan)
    assert taken == pytest.approx(plan[0].target, rel=0.1)
    assert mixing.mix(docs, Scratch(spark, "t")).where("source = 'a'").count() == sum(r["copies"] for r in plan)


# --- 6 and 9: stores, and words that are remembered


def test_names_of_stores_in_both_worlds():
    from pyarrow import fs

    from tallyhelix.llm.tokenfile import filesystem

    at, path = filesystem("file:/a/b")
    assert isinstance(at, fs.LocalFileSystem) and path == "/a/b" and filesystem("file:///a/b")[1] == "/a/b" and filesystem("/x")[1] == "/x"
    from tallyhelix.sources import bam

    assert {bam.SCHEMES[s] for s in ("s3a", "s3n")} == {"s3"} and {bam.SCHEMES[s] for s in ("wasbs", "abfss")} == {"abfs"}


def test_ids_are_the_librarys_however_few_words_are_remembered(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyhelix.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", 5)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rng = np.random.default_rng(9)
    words = ["alpha", "beta", "Ünïcode", "漢字", "don't", "x" * 300, "42½", "<|endoftext|>", "e-mail", "tab\tbed"]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(60)] + ["", " "]
    m = bpe.Model(public_tokenizers.path("word_bpe_49k.json"))
    for x in texts:
        [(ids, decoded)] = m.encode_texts([x])
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == t.decode(want, skip_special_tokens=False)
    assert len(m.word_ids) + len(m.older) < 30


def test_words_that_come_back_are_not_encoded_anew(monkeypatch):
    from tallyhelix.llm import tokenfile

    monkeypatch.setattr(tokenfile, "CACHE", 40)
    monkeypatch.setattr(tokenfile, "BATCH", 3)
    e = tokenfile.Encoder(tokenfile.default_path(tokenfile.TOKENIZER))
    encoded = Counter()

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, words, **more):
            encoded.update(words)
            return self.inner.encode_batch_fast(words, **more)

    e.of_words = Counted(e.of_words)
    common = " ".join(["the", "quick", "brown", "fox", "Ünïcode", "don't"])
    texts = [f"{common} id{i} x{i * 7919} {common}" for i in range(200)]
    want = [x.ids for x in e.splitter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, ids in zip(texts, want, strict=True):
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == ids
    assert encoded[" fox"] == encoded[" brown"] == 1
    assert len(e.known) <= 40 and len(e.before) <= 40


def test_words_are_merged_by_the_model_alone(monkeypatch):
    from tallyhelix.llm import tokenfile

    e = tokenfile.Encoder(tokenfile.default_path(tokenfile.TOKENIZER))
    t = e.splitter.tokenizer
    texts = ["", " ", "a b\tc\r\n\n d", "Ünïcode 漢字 \U0001f600 don't  x" + "y" * 400, "".join(map(chr, range(1, 700))), "<|endoftext|> and <|endoftext|>"]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    seen = []
    monkeypatch.setattr(e.of_words, "merged", lambda w, merged=e.of_words.merged: seen.append(w) or merged(w))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    assert len(seen) == len(set(seen)) > 20
