"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set is its distinct 5-word shingles, as 64-bit hashes. The global order puts shingles in
hash cells that many documents fill last (a sketch of fixed size counts them over the whole
corpus), and within a level goes by hash; any order is valid, a good one keeps common passages out of
prefixes. Pivots cut this order into ``FRAGMENTS`` of about equal mass. Two sets with Jaccard of at least 3/4 share a shingle
among the first n - ceil(3n/4) + 1 of each, which gives candidates, bounded by sizes and places. To verify a pair, overlaps
are counted in each fragment apart and summed per pair. The two rarest fragments
are counted first, and pairs that cannot reach the threshold any more go no further.
Equal sets are one node from the start, with the number of their documents.

Components come first: every set is compared with one leader of each of its keys. Keys whose sets are then in several components still are open. Sets that open keys of
more than ``CROWD`` sets connect are a crowd and compared with each other in blocks; what else shares an open key is compared pair by pair, so no candidate is left out.
A crowd that few such keys tie together (``DENSE``) would have more work in blocks than it has pairs, so it goes pair by pair too.
Links are counted after that within each component, as both ends of a link are in one. Blocks: the sets of a crowd or component are dealt into blocks of bounded
size, each pair of blocks is one group, and there the overlaps of all pairs are summed fragment by fragment as products of 0-1 matrices. No pair leaves its group as a
row, only counts of links, or of a group's links those of a forest that spans them.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing;
one to four words are one shingle; repeated rows link; ties have no influence; an empty table gives no
rows; texts of any length are taken whole; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, read, shared_keys
from .hashing import U, mix, space_bytes, words
from .words import slices, tidy

N = 5
#: Two documents link when PART * intersection >= LEAST * union.
LEAST, PART = 75, 100
FRAGMENTS, FIRST = 8, 2
#: Cells of the sketch that orders shingles, sent in blocks: a fixed 4 MB, whatever the corpus.
CELLS, BLOCK = 1 << 22, 1 << 16
CELL_BITS = 42
#: Bits of the filter that spares texts that no candidate needs: a fixed 1 MB.
FILTER_BITS = 1 << 23
#: Bytes of text that a worker takes at a time; a longer text is taken alone.
AT_ONCE = 1 << 18
#: Shingles and sets of a block, on average, and columns of a matrix.
SHINGLES, MEMBERS, COLUMNS = 1 << 18, 512, 4096
#: Keys of more sets make a crowd, if the squares of their numbers of sets, times DENSE, sum up to the square of the crowd's at least.
CROWD, DENSE = 16, 16
#: Odd numbers that tell the places of a shingle's words apart.
PLACES = tuple(mix(np.arange(1, N + 1, dtype=U)) | U(1))


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, distinct and sorted in each text, one text after the other; how many each text has)."""
    h, doc = words([(t or "").encode("utf-8", "surrogatepass") for t in texts], space_bytes())
    n = np.bincount(doc, minlength=len(texts))
    if not len(h):
        return np.zeros(0, U), n
    size = np.minimum(n, N)[doc]  # a text of fewer words is one shingle
    s = h * PLACES[0]
    for k in range(1, N):
        s[:-k] += np.where(size[:-k] > k, h[k:], U(0)) * PLACES[k]
    first = np.cumsum(n) - n
    full = np.arange(len(h)) - first[doc] + size <= n[doc]
    s, doc = mix(s[full] + size[full].astype(U)), doc[full]
    end = np.cumsum(np.bincount(doc, minlength=len(texts)))
    start = 0
    for z in end.tolist():
        s[start:z].sort()
        start = z
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(texts))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


def signatures(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U)])
    end = np.cumsum(n)
    return _signed(mix(total[end] - total[end - n] + n.astype(U)))


class Order:
    """The global order: a level for each cell, and the pivots that cut it into fragments."""

    def __init__(self, counts: np.ndarray):
        self.level = np.floor(4 * np.log2(1 + counts)).astype(np.uint8)
        mass = np.bincount(self.level, counts, 256)
        before = np.cumsum(mass) - mass
        cuts = []
        for f in range(1, FRAGMENTS):
            want = f * mass.sum() / FRAGMENTS
            at = int(np.searchsorted(before, want, "right")) - 1
            part = min(max((want - before[at]) / mass[at], 0.0), 1.0) if mass[at] else 0.0
            cuts.append((at << 56) + int(part * ((1 << 56) - 1)))
        self.pivots = np.array(cuts, U)

    def place(self, s: np.ndarray) -> np.ndarray:
        """Each shingle as its place in the order: level, then hash."""
        return (self.level[(s >> U(CELL_BITS)).astype(np.int64)].astype(U) << U(56)) | (s >> U(8))

    def fragment(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pivots, places, "right")


def sets(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Order]:
    """doc_id, n_shingles, sig of every document; and the global order of the whole corpus."""

    def run(batches):
        tidy()
        cells = np.zeros(CELLS, np.int32)
        for b in batches:
            for a, z, texts in slices(b.column("text"), AT_ONCE):
                s, n = shingles(texts)
                np.add.at(cells, (s >> U(CELL_BITS)).astype(np.int64), 1)
                none = pa.nulls(z - a, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), pa.array(n, pa.int64()), pa.array(signatures(s, n)), pa.nulls(z - a, pa.int32()), none], names=names)
        if cells.any():
            low = np.minimum(cells, 255).astype(np.uint8)  # a cell that full goes last anyway
            for i in range(0, CELLS, BLOCK):
                none = [pa.nulls(1, pa.int64()) for _ in range(3)]
                yield pa.RecordBatch.from_arrays([*none, pa.array([i // BLOCK], pa.int32()), pa.array([low[i : i + BLOCK].tobytes()], pa.binary())], names=names)

    names = ["doc_id", "n_shingles", "sig", "block", "counts"]
    t = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, sig long, block int, counts binary"), "sets")

    def add(batches):
        sums: dict = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(c, np.uint8).astype("<i8")
                sums[k] = sums[k] + got if k in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    per = t.where("block is not null").select("block", "counts").repartition(CELLS // BLOCK, "block").mapInArrow(add, "block int, counts binary")
    sketch = np.zeros(CELLS, np.int64)
    for r in per.toArrow().to_pylist():  # CELLS numbers
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["counts"], "<i8")
    return t.where("block is null").select("doc_id", "n_shingles", "sig"), Order(sketch)


def prefix_postings(docs: DataFrame, order: Order) -> DataFrame:
    """(key, id, n, pos): the first shingles of each set in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # 4 MB

    def run(batches):
        tidy()
        for b in batches:
            for _, _, texts in slices(b.column("text"), AT_ONCE):
                s, n = shingles(list(dict.fromkeys(texts)))
                places, sig = shared.value.place(s), signatures(s, n)
                size = np.where(n > 0, n + (-LEAST * n) // PART + 1, 0)
                end, heads = np.cumsum(n), []
                for a, z, p in zip((end - n).tolist(), end.tolist(), size.tolist(), strict=True):
                    if p:
                        own = places[a:z]
                        own.sort()
                        heads.append(own[:p])
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                key = np.concatenate(heads) if heads else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(np.repeat(sig, size)), pa.array(np.repeat(n, size), pa.int32()), pa.array(pos, pa.int32())], names=["key", "id", "n", "pos"])

    return docs.select("text").mapInArrow(run, "key long, id long, n int, pos int")


#: Sizes allow the threshold, and so do the places of the shared shingle.
FITS = f"{PART} * least(x.n, y.n) >= {LEAST} * greatest(x.n, y.n) and {PART + LEAST} * least(x.n - x.pos, y.n - y.pos) >= {LEAST} * (x.n + y.n)"


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) >> U(41)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits over the hashes of (doc_id); never misses one of them."""

    def mark(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            at = _bit(np.asarray(b.column("doc_id")))
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    def join(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            for x in b.column("bits").to_pylist():
                bits |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    marked = ids.select("doc_id").where("doc_id is not null").mapInArrow(mark, "bits binary").repartition(16).mapInArrow(join, "bits binary")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marked.toArrow().to_pylist():  # sixteen bitmaps
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def segments(docs: DataFrame, order: Order, wanted: np.ndarray, low: int, high: int) -> DataFrame:
    """(id, n, frag, part): the sets of documents that pass the filter, as places in the global order, cut into fragments low..high-1."""
    shared = docs.sparkSession.sparkContext.broadcast((order, wanted))  # 5 MB
    width = high - low

    def run(batches):
        tidy()
        order, bits = shared.value
        for b in batches:
            ids = b.column("doc_id")
            at = _bit(np.asarray(ids.fill_null(0)))
            pass_ = np.asarray(ids.is_null()) | ((bits[at >> 3] & (128 >> (at & 7))) > 0)
            for _, _, texts in slices(b.column("text").filter(pa.array(pass_)), AT_ONCE):
                texts = list(dict.fromkeys(texts))
                s, n = shingles(texts)
                places, sig = order.place(s), signatures(s, n)
                end = np.cumsum(n)
                for a, z in zip((end - n).tolist(), end.tolist(), strict=True):
                    places[a:z].sort()
                frag = order.fragment(places)
                use = (frag >= low) & (frag < high)
                cell = np.repeat(np.arange(len(texts)), n)[use] * width + frag[use] - low
                count = np.bincount(cell, minlength=len(texts) * width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(_signed(places[use])))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sig, width)), pa.array(np.repeat(n, width), pa.int32()), pa.array(np.tile(np.arange(low, high), len(texts)), pa.int32()), lists], names=["id", "n", "frag", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, n int, frag int, part array<long>")


def overlaps(pairs: DataFrame, segs: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b, got, na, nb, rest): shingles shared in fragments low..high-1, and the most that the others can add."""
    p = pairs.select("a", "b", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("frag"))
    left = segs.select(F.col("id").alias("a"), "frag", F.col("n").alias("na"), F.col("part").alias("pa"))
    right = segs.select(F.col("id").alias("b"), "frag", F.col("n").alias("nb"), F.col("part").alias("pb"))
    both = p.join(left, ["a", "frag"]).join(right, ["b", "frag"])
    both = both.select("a", "b", "frag", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("k"), F.size("pa").alias("sa"), F.size("pb").alias("sb"))
    # a set may have come from several copies of its text: each fragment counts once
    both = both.groupBy("a", "b", "frag").agg(*[F.max(c).alias(c) for c in ("na", "nb", "k", "sa", "sb")])
    return both.groupBy("a", "b").agg(F.sum("k").alias("got"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.least(F.max("na") - F.sum("sa"), F.max("nb") - F.sum("sb")).alias("rest"))


def partial_overlaps(size: np.ndarray, values: np.ndarray, first: int) -> np.ndarray:
    """Overlaps of the sets before ``first`` with those from there on, or of all with all where nothing is before; sets are runs of ``size`` values."""
    total = np.zeros((first or len(size), len(size) - first), np.int64)
    _, col, times = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1  # what only one set has is in no overlap with another
    some = (times > 1)[col]
    row, col = np.repeat(np.arange(len(size)), size)[some], rank[col[some]]
    wide = int(rank[-1]) + 1 if len(rank) else 0
    for c in range(0, wide, COLUMNS):
        here = (col >= c) & (col < c + COLUMNS)
        m = np.zeros((len(size), min(COLUMNS, wide - c)), np.float32)
        m[row[here], col[here] - c] = 1
        total += np.rint(m[: first or len(size)] @ m[first:].T).astype(np.int64)
    return total


class Blocks:
    """One pair of blocks of a group: overlaps of its sets, summed over the fragments as they come."""

    def __init__(self, i: int, j: int):
        self.same, self.i, self.ids, self.got = i == j, i, None, None

    def add(self, sig, block, n, copies, size, values) -> None:
        """One fragment of all sets, in the order of (block, sig); a set that comes twice, as copies of a text may have it do, counts once."""
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        values = values[np.repeat(new, size)]
        sig, block, n, copies, size = (x[new] for x in (sig, block, n, copies, size))
        if self.ids is None:
            self.ids, self.n, self.copies = sig, n, copies
            self.first = 0 if self.same else int((block == self.i).sum())
        if self.same or 0 < self.first < len(sig):
            part = partial_overlaps(size, values, self.first)
            self.got = part if self.got is None else self.got + part

    def links(self):
        """(ids of the rows, ids of the columns, which of them link, copies of the rows, of the columns); None where a block has no sets."""
        if self.got is None:
            return None
        a, b = slice(0, self.first or len(self.ids)), slice(self.first, len(self.ids))
        link = (PART + LEAST) * self.got >= LEAST * (self.n[a, None] + self.n[None, b])
        if self.same:
            np.fill_diagonal(link, False)
        return self.ids[a], self.ids[b], link, self.copies[a], self.copies[b]


def forest(a: list, b: list, link: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that ``link`` connects, fewer than there are ids."""
    up: dict = {k: k for k in [*a, *b]}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, row in zip(a, link, strict=True):
        for y in np.flatnonzero(row).tolist():
            p, q = top(x), top(b[y])
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((x, b[y]))
    return out


def by_blocks(members: DataFrame, segs: DataFrame, give, schema: str) -> DataFrame:
    """give(links) of every pair of blocks of every group; members (sig, grp, copies, n), segs (id, frag, part).

    A task holds one fragment of two blocks at a time, and their matrix of overlaps.
    """
    per = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    per = per.withColumn("blocks", F.greatest(F.ceil(F.col("size") / SHINGLES), F.ceil(F.col("m") / MEMBERS)).cast("int"))
    own = members.join(per, "grp").withColumn("block", F.pmod(F.xxhash64("sig", F.lit(3)), F.col("blocks")).cast("int"))
    own = own.join(segs.select(F.col("id").alias("sig"), "frag", "part"), "sig")
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "frag", "block", "sig", "n", "copies", "part")
    names = ("sig", "block", "n", "copies")

    def runs(batches):
        """((grp, i, j, frag), columns) of each fragment of each pair of blocks."""
        now, pieces = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("grp", "i", "j", "frag")], 1)
            cols = [np.asarray(b.column(c)).astype(np.int64) for c in names]
            size = np.asarray(pa.compute.list_value_length(b.column("part"))).astype(np.int64)
            values, end = np.asarray(b.column("part").flatten()), np.cumsum(size)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                key = tuple(keys[a].tolist())
                if key != now and pieces:
                    yield now, [np.concatenate(x) for x in zip(*pieces, strict=True)]
                    pieces = []
                now = key
                pieces.append([*[c[a:z] for c in cols], size[a:z], values[end[a] - size[a] : end[z - 1]]])
        if pieces:
            yield now, [np.concatenate(x) for x in zip(*pieces, strict=True)]

    def run(batches):
        tidy()
        now, blocks = None, None
        for key, cols in runs(batches):
            if key[:3] != now:
                if blocks and (got := blocks.links()):
                    yield give(*got)
                now, blocks = key[:3], Blocks(*key[1:3])
            blocks.add(*cols)
        if blocks and (got := blocks.links()):
            yield give(*got)

    by = ["grp", "i", "j"]
    return met.repartition(*by).sortWithinPartitions(*by, "frag", "block", "sig").mapInArrow(run, schema)


def link_counts(members: DataFrame, segs: DataFrame) -> DataFrame:
    """(sig, near): documents of other sets of its group that each set links with."""

    def give(a, b, link, copies_a, copies_b):
        ids, near = a, link @ copies_b
        if a[0] != b[0]:  # two blocks: a link counts on both sides
            ids, near = np.concatenate([a, b]), np.concatenate([near, link.T @ copies_a])
        return pa.RecordBatch.from_pydict({"sig": pa.array(ids, pa.int64()), "near": pa.array(near, pa.int64())})

    return by_blocks(members, segs, give, "sig long, near long").groupBy("sig").agg(F.sum("near").alias("near"))


def spanning_links(members: DataFrame, segs: DataFrame) -> DataFrame:
    """(a, b): links within groups, enough to connect all that link."""

    def give(a, b, link, *_):
        edges = forest(a.tolist(), b.tolist(), link)
        return pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return by_blocks(members, segs, give, "a long, b long")


def component_ids(docs: DataFrame, scratch: Scratch, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, and with ``links`` n_links, the number of other documents that link with this one."""
    t, order = sets(docs, scratch)
    postings = scratch.table(prefix_postings(docs, order), "prefixes")
    met = shared_keys(scratch, postings)
    scratch.drop(postings)
    full = t.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    named = scratch.table(full, "named")  # a text of each set

    def parts(ids: DataFrame, low: int, high: int) -> DataFrame:
        return scratch.table(segments(docs, order, id_filter(named.join(ids, "sig")), low, high), "segments")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        enough = f"{PART + LEAST} * (got + {{}}) >= {LEAST} * (na + nb)"
        segs = parts(ends(pairs), 0, FIRST)
        early = scratch.table(overlaps(pairs, segs, 0, FIRST).where(enough.format("rest")), "early", pairs.count())
        scratch.drop(segs)
        scratch.free()
        segs = parts(ends(early), FIRST, FRAGMENTS)
        late = overlaps(early.select("a", "b"), segs, FIRST, FRAGMENTS).select("a", "b", F.col("got").alias("more"))
        out = scratch.table(early.join(late, ["a", "b"]).where(enough.format("more")).select("a", "b"), "verified", pairs.count())
        scratch.drop(segs, early)
        scratch.free()
        return out

    def candidates(x: DataFrame, y: DataFrame, where: str) -> DataFrame:
        return scratch.table(x.join(y, "key").where(f"{where} and {FITS}").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "pairs")

    # every set against the leader, the least id, of each of its keys
    x = met.select("key", F.struct("id", "n", "pos").alias("x"))
    led = candidates(x.groupBy("key").agg(F.min("x").alias("x")), met.select("key", F.struct("id", "n", "pos").alias("y")), "x.id < y.id")
    found = verify(led)
    comps = scratch.table(components(scratch, found), "leaders")
    where = scratch.table(named.select(F.col("sig").alias("id"), "copies", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "where")

    # keys of sets that are in several components still; crowds in blocks
    here = met.join(where.select("id", "comp"), "id")
    per = here.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m"), F.min("id").alias("first"))
    open_ = scratch.table(per.where("c0 <> c1").select("key", "m", "first"), "open")
    here = scratch.table(here.join(open_, "key"), "mixed")
    crowded = here.where(F.col("m") > CROWD)
    crowds = scratch.table(components(scratch, crowded.select(F.col("id").alias("a"), F.col("first").alias("b"))), "crowds")
    pairs_of = open_.where(F.col("m") > CROWD).join(crowds.withColumnRenamed("id", "first"), "first").groupBy("comp").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
    dense = crowds.groupBy("comp").agg(F.count("*").cast("double").alias("all")).join(pairs_of, "comp").where(F.col("pairs") * DENSE >= F.col("all") * F.col("all"))
    crowd = scratch.table(crowds.join(dense.select("comp"), "comp").withColumnRenamed("comp", "grp"), "crowd")
    if not crowd.isEmpty():
        segs = parts(crowd.select(F.col("id").alias("sig")), 0, FRAGMENTS)
        members = where.select("id", "copies", "n").join(crowd, "id").withColumnRenamed("id", "sig")
        found = found.unionByName(scratch.table(spanning_links(members, segs), "spans"))
        scratch.drop(segs)
        comps = scratch.table(components(scratch, found), "joined")
        where = where.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    # the others that share a key, pair by pair; all sets of a crowded key are of one crowd
    done = open_.where(F.col("m") > CROWD).select("key", F.col("first").alias("id")).join(crowd, "id").select("key")
    left = here.select("key", "id", "n", "pos").join(done, "key", "left_anti").join(where.select("id", "comp"), "id").join(crowd, "id", "left")
    left = scratch.table(left.withColumn("grp", F.coalesce("grp", "id")), "left")
    side = lambda name: left.select("key", F.struct("id", "n", "pos", "comp", "grp").alias(name))
    rest = candidates(side("x"), side("y"), "x.id < y.id and x.comp <> y.comp and x.grp <> y.grp").join(led, ["a", "b"], "left_anti")
    rest = scratch.table(rest, "rest")
    if not rest.isEmpty():
        comps = scratch.table(components(scratch, found.unionByName(verify(rest))), "comps")
    scratch.drop(met, here)
    of_sets = named.select("sig", "copies", "n").join(comps.select(F.col("id").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    of_sets = scratch.table(of_sets, "components")
    least = t.where("n_shingles > 0").select("doc_id", "sig").join(of_sets.select("sig", "comp"), "sig").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    more = []
    if links:
        size = of_sets.groupBy("comp").agg(F.count("*").alias("m"), F.sum("copies").alias("all"))
        of_sets = scratch.table(of_sets.join(size, "comp"), "sizes")
        crowd = of_sets.where("m > 2").select("sig", F.col("comp").alias("grp"), "copies", "n")
        near = scratch.table(link_counts(crowd, parts(crowd.select("sig"), 0, FRAGMENTS)), "near")
        # the two sets of a component of two link with each other
        of_sets = of_sets.join(near, "sig", "left").withColumn("n_links", F.col("copies") - 1 + F.when(F.col("m") == 2, F.col("all") - F.col("copies")).otherwise(F.coalesce("near", F.lit(0))))
        more = ["n_links"]
    out = t.where("n_shingles > 0").join(of_sets.join(least, "comp").select("sig", "component_id", *more), "sig").select("doc_id", "n_shingles", "component_id", *more)
    rest = t.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if links else []))
    return out.unionByName(rest)


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each group of documents that link, the row of the least id; rows are told apart by all their columns, so repeated ids do no harm."""
    [own] = fresh(docs.columns, "own")
    named = docs.withColumn(own, F.xxhash64(F.struct(*docs.columns)))
    ids = scratch.table(named.select(F.col(own).alias("row"), F.col("doc_id").alias("id")), "ids")
    comps = component_ids(named.select(F.col(own).alias("doc_id"), "text"), scratch, links=False)
    least = ids.join(comps.select(F.col("doc_id").alias("row"), "component_id"), "row").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("least"))
    stay = scratch.table(least.select(F.col("least.row").alias(own)), "stay")
    out = named.join(stay, own, "left_semi")
    if not ids.groupBy("row").count().where("count > 1").isEmpty():  # equal rows are one
        out = out.dropDuplicates([own])
    return out.drop(own)


def op3_jaccard(spark, sf_dir):
    return component_ids(read(spark, sf_dir, "documents"), Scratch(spark, "op3"))
