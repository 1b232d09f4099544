"""Which terms and which other sources set a source of a language apart.

A term is a run of letters of ASCII, lower-cased, and characters beyond ASCII. Each lang keeps the terms that stand in at least
``LEAST`` of its documents, V of them. With N occurrences of kept terms in a group (a lang's source, or the whole lang), a kept
term that occurs ``count`` times there has p = 1 + floor(1e9 * (count + 1) / (N + V)), a whole number; two groups
diverge at a term by f = floor((p - q) ** 2 / q).

*Terms.* The terms of a group that are likelier than in its lang, the ``RANKS`` with the largest f, ties by the bytes of the term. They
are found by radix selection: a histogram of a group's values over their twelve highest bits shows in which of its bins the
last rank lies, the next histogram is of the bits below within that bin, and so on; terms of one value are told apart by their
bytes in the same way. A histogram is one grouped count, so no group is sorted or gathered; at most
``RANKS`` + ``LOCAL`` rows of a group meet at the end.

*Pairs.* f summed over all V terms, for each two sources of a lang, without a row for a term that neither has: a group gives all its missing
terms one p, the baseline. The sum is V times f of both baselines, plus, for each distinct p of either group, the difference that it makes against the
other's baseline times the number of terms that have it, plus a correction for each term that both have.

Defined cases: null text, lang and source are ''; every row is a document, repeated ids too; a group without kept terms has
p of count 0; a lang without kept terms has pairs of value 0 and no terms; an empty table gives no rows; extra columns are
not read. Texts of any length are counted piece by piece.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded, read
from .words import slices

#: Documents of a lang that a kept term stands in, and ranks of terms in a group.
LEAST, RANKS = 3, 200
#: Bits of one histogram, and of a value: f is at most 10 ** 18.
DIGIT, BITS = 12, 60
#: A bin with at most so many rows is not looked into any further.
LOCAL = 256
#: Bytes of text that a worker takes at a time, and entries and bytes after which it hands over its counts.
AT_ONCE, ENTRIES, HELD = 1 << 20, 100_000, 1 << 25
#: Each byte of a term as it is, A-Z lower-cased; any other byte is a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ONE = 1_000_000_000


def terms(raw: bytes):
    """Lists of the terms of a text, in runs of about a megabyte, cut between terms."""
    clean, at = raw.translate(TERM_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + AT_ONCE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; counts of a worker are put together before the shuffle."""
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]

    def handed(n, docs):
        keys = [(g, t) for g, c in n.items() for t in c]
        cols = [pa.array([g[i] for g, _ in keys], pa.string()) for i in (0, 1)]
        term = pa.array([t for _, t in keys], pa.binary()).view(pa.string())
        counts = [pa.array([c[g][t] for g, t in keys], pa.int64()) for c in (n, docs)]
        return pa.RecordBatch.from_arrays([*cols, term, *counts], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        n, docs, entries, held = defaultdict(Counter), defaultdict(Counter), 0, 0
        for b in batches:
            for a, z, texts in slices(b.column("text"), AT_ONCE):
                groups = zip(b.column("lang").slice(a, z - a).to_pylist(), b.column("source").slice(a, z - a).to_pylist(), strict=True)
                for g, raw in zip(groups, texts, strict=True):
                    own, seen = n[g], set()
                    before = len(own)
                    for words in terms(raw):
                        own.update(words)
                        seen.update(words)
                    docs[g].update(seen)
                    entries, held = entries + len(own) - before, held + len(raw)
                if entries >= ENTRIES or held >= HELD:
                    yield handed(n, docs)
                    n, docs, entries, held = defaultdict(Counter), defaultdict(Counter), 0, 0
        if entries:
            yield handed(n, docs)

    raw = docs.select(*named, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    got = raw.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / total), exact: in longs while they hold the product."""
    up = count + 1
    wide = (F.lit(ONE).cast("decimal(10,0)") * up.cast("decimal(19,0)"), total.cast("decimal(19,0)"))
    return 1 + F.when(up < 9 * ONE, _div(up * ONE, total)).otherwise(_div(*wide))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), in longs: p and q are at most 1e9 + 1."""
    return _div((p - q) * (p - q), q)


def top(rows: DataFrame, by: list[str], k: int, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """rows (by, item, value) with ``rank`` from 1 to k in each group: value descending, then the bytes of the item ascending.

    rows is a written table, items of a group differ, values are not negative and below 2 ** BITS.
    """
    key = F.concat(F.hex(F.col("item").cast("binary")), F.lit("!"))  # the end sorts before any byte
    # of every group: where its last rank lies, as a prefix of the value's bits above ``shift`` and of the key
    state = rows.groupBy(*by).agg(F.count("*").alias("size")).select(*by, F.lit(k).cast("long").alias("need"), F.lit(BITS).alias("shift"), F.lit(0).cast("long").alias("prefix"), F.lit("").alias("tie"), "size")
    state = scratch.table(state.withColumn("open", F.col("size") > F.greatest(F.col("need"), F.lit(local))), "state")
    while True:
        todo = state.where("open")
        if todo.isEmpty():
            break
        here = rows.join(bounded(todo), by).where(F.expr("shiftright(value, shift) = prefix")).withColumn("_key", key)
        here = here.where((F.col("tie") == "") | F.col("_key").startswith(F.col("tie")))
        digit = F.when(F.col("shift") > 0, F.lpad(F.expr(f"hex({(1 << DIGIT) - 1} - (shiftright(value, shift - {DIGIT}) & {(1 << DIGIT) - 1}))"), 3, "0")).otherwise(F.substring("_key", F.length("tie") + 1, F.lit(2)))
        bins = here.groupBy(*by, "need", "shift", "prefix", "tie", digit.alias("digit")).agg(F.count("*").alias("n"))  # at most 2 ** DIGIT a group
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("digit")))
        bins = bins.where("upto >= need and upto - n < need").withColumn("need", F.expr("need - (upto - n)"))
        high = F.col("shift") > 0
        moved = bins.select(
            *by, "need", F.when(high, F.col("shift") - DIGIT).otherwise(0).alias("shift"),
            F.when(high, F.expr(f"shiftleft(prefix, {DIGIT}) + {(1 << DIGIT) - 1} - conv(digit, 16, 10)").cast("long")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(high, F.col("tie")).otherwise(F.concat("tie", "digit")).alias("tie"), F.col("n").alias("size"),
        )
        moved = moved.withColumn("open", (F.col("size") > local) & (F.col("size") > F.col("need")))
        nxt = scratch.table(state.where("not open").unionByName(moved), "state")
        scratch.drop(state)
        state = nxt
    near = rows.join(bounded(state.select(*by, "shift", "prefix", "tie")), by).withColumn("_high", F.expr("shiftright(value, shift)")).withColumn("_key", key)
    near = near.where((F.col("_high") > F.col("prefix")) | (F.col("_high") == F.col("prefix")) & (F.substring("_key", F.lit(1), F.length("tie")) <= F.col("tie")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))  # at most k + local rows of a group, or k
    return near.withColumn("rank", place).where(F.col("rank") <= k).select(*rows.columns, "rank")


def divergence(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, part, item, value, rank."""
    group = ["lang", "source"]
    counts = scratch.table(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("docs").alias("d")).where(F.col("d") >= LEAST).drop("d")
    kept = scratch.table(kept, "kept")
    cells = scratch.table(counts.drop("docs").join(kept, ["lang", "term"]), "cells")
    scratch.drop(counts)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("ln").alias("lang_total"))
    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in group]).distinct()
    own = cells.groupBy(*group).agg(F.sum("n").alias("total"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = every.join(own, group, "left").join(langs, "lang", "left").select(*group, none("total"), none("v"), none("lang_total"))
    groups = groups.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total") + F.col("v"))).otherwise(1))
    groups = scratch.table(groups, "groups", 1)
    sent = bounded(groups)

    p = share(F.col("n"), F.col("total") + F.col("v"))
    q = share(F.col("ln"), F.col("lang_total") + F.col("v"))
    probs = scratch.table(cells.join(sent, group).select(*group, F.col("term").alias("item"), p.alias("p"), q.alias("q"), "base"), "probs")
    scratch.drop(kept, cells)
    likelier = scratch.table(probs.where("p > q").select(*group, "item", apart(F.col("p"), F.col("q")).alias("value")), "likelier")
    words = top(likelier, group, RANKS, scratch).withColumn("part", F.lit("term"))

    # how many terms of a group have each p: far fewer rows than terms
    spread = scratch.table(probs.groupBy(*group, "p", "base").agg(F.count("*").alias("m")), "spread")
    other = sent.select("lang", F.col("source").alias("o"), F.col("base").alias("o_base"))
    met = spread.join(other, "lang").where("source <> o")
    same, base, o_base = F.col("p"), F.col("base"), F.col("o_base")
    mine = met.select("lang", "source", F.col("o").alias("item"), (F.col("m") * (apart(same, o_base) - apart(base, o_base))).alias("value"))
    theirs = met.select("lang", F.col("o").alias("source"), F.col("source").alias("item"), (F.col("m") * (apart(o_base, same) - apart(o_base, base))).alias("value"))
    base_of = groups.join(other, "lang").where("source <> o").select("lang", "source", F.col("o").alias("item"), (F.col("v") * apart(base, o_base)).alias("value"))
    side = lambda s: probs.select("lang", "item", F.struct("source", "p", "base").alias(s))
    shared = side("x").join(side("y"), ["lang", "item"]).where("x.source < y.source")

    def bent(a: str, b: str) -> Column:
        p, p0, q, q0 = F.col(f"{a}.p"), F.col(f"{a}.base"), F.col(f"{b}.p"), F.col(f"{b}.base")
        return apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)

    both = shared.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(bent("x", "y")).alias("ab"), F.sum(bent("y", "x")).alias("ba"))
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))).alias("r")).select("lang", "r.*")
    pairs = mine.unionByName(theirs).unionByName(base_of).unionByName(both).groupBy(*group, "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))  # one row for each other source of the lang
    pairs = pairs.withColumn("rank", place).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(words.select(columns))


def op13_divergence(spark, sf_dir):
    return divergence(read(spark, sf_dir, "documents"), Scratch(spark, "op13"))


OP13_SQL = r"""with docs as (select coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') body, row_number() over () r from documents),
words as (select r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
kept as materialized (select lang, term, count(*) ln from words group by 1, 2 having count(distinct r) >= 3),
counts as materialized (select lang, source, term, count(*) n from words join kept using (lang, term) group by 1, 2, 3),
langs as (select lang, count(*) v, sum(ln) lt from kept group by 1),
own as (select lang, source, sum(n) total from counts group by 1, 2),
groups as materialized (select g.lang, g.source, coalesce(total, 0) total, coalesce(v, 0) v, lt from (select distinct lang, source from docs) g left join own on own.lang = g.lang and own.source = g.source left join langs on langs.lang = g.lang),
probs as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.total + g.v)::hugeint p, 1 + 1000000000::hugeint * (k.ln + 1) // (g.lt + g.v)::hugeint q
  from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select g.lang, g.source, o.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint as value from groups g join groups o on o.lang = g.lang and o.source <> g.source
  left join probs x on x.lang = g.lang and x.source = g.source left join probs y on y.lang = o.lang and y.source = o.source and y.term = x.term where x.term is null or y.term is not null group by 1, 2, 3),
found as (select lang, source, 'term' part, term item, ((p - q) * (p - q) // q)::bigint as value from probs where n > 0 and p > q union all select lang, source, 'pair', item, value from pairs)
select * from (select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from found) where part = 'pair' or rank <= 200"""
