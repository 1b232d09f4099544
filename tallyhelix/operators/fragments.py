"""Alignments to fragments: filters, pairs in read order, the interpreter of split reads, breakpoints.

One shuffle groups alignments by (sample, qname); everything after is expressions on short arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhelix.functions.scalar import MIN_MAPQ, REJECT_FLAGS, cigar_ref_length, first_read_forward, first_unclipped, has_bits, let

KEY = ("sample", "qname")
#: Windows of a capture kit that may be sent to every executor.
KIT = 500_000


def sent(windows: DataFrame) -> DataFrame:
    """Windows to be sent to every executor if there are at most ``KIT``, else as they are."""
    return F.broadcast(windows) if windows.limit(KIT + 1).count() <= KIT else windows


def usable(alignments: DataFrame) -> DataFrame:
    """Well mapped, paired, none of the rejected flags; supplementary alignments stay."""
    flag = F.col("flag")
    return alignments.where((F.col("mapq") >= MIN_MAPQ) & has_bits(flag, 1) & has_bits(flag, REJECT_FLAGS, 0))


def on_known_chroms(alignments: DataFrame, windows: DataFrame) -> DataFrame:
    return alignments.join(windows.select("chrom").distinct(), "chrom", "left_semi")


def placed(alignments: DataFrame) -> DataFrame:
    """Adds the end on the reference and the first unclipped base of the read."""
    return alignments.withColumn("end_pos", F.col("pos") + cigar_ref_length(F.col("cigar")) - 1).withColumn("on_read", first_unclipped(F.col("cigar")))


def _in_read_order(items: Column) -> Column:
    """Two alignments of a strand in the order of the read; ties keep the order of input."""
    two = F.array_sort(F.transform(items, lambda a: F.struct(a["on_read"], a["ord"], a["s"], a["e"])))
    return F.transform(F.when(F.size(items) == 2, two).otherwise(F.transform(items, lambda a: F.struct(a["on_read"], a["ord"], a["s"], a["e"]))), lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e")))


def qnames(alignments: DataFrame) -> DataFrame:
    """One row per (sample, qname): chroms, first-read strands, and the strands' alignments in read order."""
    forward = (F.col("flag").bitwiseAND(F.lit(16)) == 0).alias("fwd")
    item = F.struct("ord", forward, F.col("on_read"), F.col("pos").alias("s"), F.col("end_pos").alias("e"))
    g = placed(alignments).withColumn("ff", first_read_forward(F.col("flag")))
    g = g.groupBy(*KEY).agg(F.min("chrom").alias("chrom"), F.max("chrom").alias("chrom_max"), F.min("ff").alias("ff"), F.max("ff").alias("ff_max"), F.array_sort(F.collect_list(item)).alias("items"))
    return g.withColumn("f", _in_read_order(F.filter("items", lambda a: a["fwd"]))).withColumn("r", _in_read_order(F.filter("items", lambda a: ~a["fwd"]))).drop("items")


def one_chrom(q: DataFrame) -> DataFrame:
    return q.where("chrom = chrom_max")


def one_orientation(q: DataFrame) -> DataFrame:
    return q.where("ff = ff_max")


def fit_strands(q: DataFrame) -> DataFrame:
    """One or two alignments on each strand."""
    return q.where("size(f) between 1 and 2 and size(r) between 1 and 2")


def joined(items: Column) -> Column:
    """Two alignments of a strand that overlap become one."""
    starts, ends = F.transform(items, lambda a: a["s"]), F.transform(items, lambda a: a["e"])
    one = F.array(F.struct(F.array_min(starts).alias("s"), F.array_max(ends).alias("e")))
    return F.when((F.size(items) == 2) & (F.array_min(ends) > F.array_max(starts)), one).otherwise(items)


def _interval(s: Column, e: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"))


def _break(s: Column, e: Column, kind: str) -> Column:
    return F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("kind"))


def _facing(a, b, max_gap: int) -> Column:
    """Intervals of a forward and a reverse alignment that overlap or face each other closely, else null."""
    whole = F.array(_interval(F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"])))
    apart = F.array(_interval(a["s"], a["e"]), _interval(b["s"], b["e"]))
    return F.when((a["s"] <= b["e"]) & (a["e"] >= b["s"]), whole).when((a["s"] <= b["e"]) & (b["s"] - a["e"] <= max_gap), apart)


def _result(frags: Column, bp: Column | None) -> Column:
    none = F.lit(None).cast("struct<s:long,e:long,kind:string>")
    return F.struct(frags.cast("array<struct<s:long,e:long>>").alias("frags"), (none if bp is None else bp.cast("struct<s:long,e:long,kind:string>")).alias("bp"))


def _base(p, max_gap: int) -> Column:
    """Intervals of the parts that face each other: of a split strand, the second part of its read."""
    f, r = p["f"], p["r"]
    f1, f2, r1, r2 = F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(r, F.lit(0)), F.get(r, F.lit(1))
    return F.when(F.size(f) == 2, _facing(f2, r1, max_gap)).when(F.size(r) == 2, _facing(f1, r2, max_gap)).otherwise(F.when(f1["s"] < r1["e"], _facing(f1, r1, max_gap)))


def _explained(p) -> Column:
    """struct(frags, bp) from struct(f, r, b), or null."""
    f, r, b = p["f"], p["r"], p["b"]
    f1, f2, r1, r2 = F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(r, F.lit(0)), F.get(r, F.lit(1))
    first, last = F.element_at(b, 1), F.element_at(b, -1)
    but_last, but_first = F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0)))
    one = F.size(b) == 1

    own = _interval(f1["s"], f1["e"])
    grown = _interval(F.least(last["s"], f1["s"]), F.greatest(last["e"], f1["e"]))
    split_f = F.when(
        f1["s"] < f2["s"],
        F.when(f1["e"] < first["s"], _result(F.concat(F.array(own), b), _break(f1["e"], first["s"], "DEL"))),
    ).otherwise(
        F.when(last["e"] < f1["s"], _result(F.concat(b, F.array(own)), _break(first["s"], f1["e"], "DUP"))).when(
            last["s"] < f1["e"], _result(F.concat(but_last, F.array(grown)), _break(F.when(one, grown["s"]).otherwise(first["s"]), grown["e"], "DUP"))
        )
    )

    own = _interval(r1["s"], r1["e"])
    grown = _interval(F.least(first["s"], r1["s"]), F.greatest(first["e"], r1["e"]))
    split_r = F.when(
        r2["s"] < r1["s"],
        F.when(last["e"] < r1["s"], _result(F.concat(b, F.array(own)), _break(last["e"], r1["s"], "DEL"))),
    ).otherwise(
        F.when(r1["e"] < first["s"], _result(F.concat(F.array(own), b), _break(r1["s"], last["e"], "DUP"))).when(
            first["s"] < r1["e"], _result(F.concat(F.array(grown), but_first), _break(grown["s"], F.when(one, grown["e"]).otherwise(last["e"]), "DUP"))
        )
    )

    meets = lambda a, c: (a["s"] <= c["e"]) & (a["e"] >= c["s"])
    crossed = meets(f1, r2) & meets(f2, r1)
    outer = _interval(F.least(f1["s"], r2["s"]), F.greatest(f1["e"], r2["e"]))
    inner = _interval(F.least(f2["s"], r1["s"]), F.greatest(f2["e"], r1["e"]))
    both = F.when((f1["s"] < f2["s"]) & (r1["s"] > r2["s"]) & crossed, _result(F.array(outer, inner), _break(outer["e"], inner["s"], "DEL")))
    both = both.when((f1["s"] > f2["s"]) & (r1["s"] < r2["s"]) & crossed, _result(F.array(inner, outer), _break(inner["s"], outer["e"], "DUP")))

    shape = F.size(f) * 10 + F.size(r)
    return F.when(shape == 22, both).when(b.isNull(), None).when(shape == 11, _result(b, None)).when(shape == 21, split_f).when(shape == 12, split_r)


def interpreted(q: DataFrame, max_gap: int = 1000) -> DataFrame:
    """(sample, qname, chrom, frag) of each qname that can be explained, ``frag`` a struct(frags, bp); others go.

    Plain pairs give one or two intervals; a split read on one or both strands adds a deletion or a
    duplication breakpoint, by whether the read's parts lie in order or inverted.
    """
    strands = F.struct(joined(F.col("f")).alias("f"), joined(F.col("r")).alias("r"))
    frag = let(strands, lambda p: let(F.struct(p["f"].alias("f"), p["r"].alias("r"), _base(p, max_gap).alias("b")), _explained))
    return q.select(*KEY, "chrom", F.explode(F.filter(F.array(frag), lambda x: x.isNotNull())).alias("frag"))


def fragments(alignments: DataFrame, windows: DataFrame, max_gap: int = 1000) -> DataFrame:
    """(sample, qname, chrom, frag) from raw alignments."""
    q = qnames(on_known_chroms(usable(alignments), windows))
    return interpreted(fit_strands(one_orientation(one_chrom(q))), max_gap)


def intervals(frags: DataFrame) -> DataFrame:
    return frags.select(*KEY, "chrom", F.explode("frag.frags").alias("i")).select(*KEY, "chrom", F.col("i.s").alias("s"), F.col("i.e").alias("e"))


def overlaps(parts: DataFrame, windows: DataFrame, width: int = 4096) -> DataFrame:
    """(sample, qname, widx), each once: half-open overlap of intervals and windows.

    Both sides are cut into bins of ``width`` bases, so the join is by (chrom, bin) and
    a task meets only windows near its intervals; the residual condition decides. At most ``KIT`` windows are sent to every
    executor, which keeps the intervals' partitioning by (sample, qname) for the last step; more are shuffled.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(e / width)))
    p = parts.withColumn("bin", bins(F.col("s"), F.col("e")))
    w = windows.select("chrom", "widx", F.col("st").alias("ws"), F.col("en").alias("we"), bins(F.col("st"), F.col("en")).alias("bin"))
    return p.join(sent(w), ["chrom", "bin"]).where("s < we and ws < e").select(*KEY, "widx").distinct()


def breakpoints(frags: DataFrame) -> DataFrame:
    """(sample, chrom, start, end, cnvtype, n_qnames, qnames)."""
    b = frags.where("frag.bp is not null").select("sample", "qname", "chrom", "frag.bp.*")
    return b.groupBy("sample", "chrom", F.col("s").alias("bp_start"), F.col("e").alias("bp_end"), F.col("kind").alias("cnvtype")).agg(F.count("*").alias("n_qnames"), F.array_join(F.sort_array(F.collect_list("qname")), ",").alias("qnames"))


def counted(hits: DataFrame, samples: DataFrame, windows: DataFrame) -> DataFrame:
    """(sample, widx, n) for every sample and window, zeros kept."""
    n = hits.groupBy("sample", "widx").agg(F.count("*").alias("n"))
    every = samples.select("sample").crossJoin(sent(windows.select("widx")))
    return every.join(n, ["sample", "widx"], "left").select("sample", "widx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
