"""Codes of vectors by parts: eight codebooks of sixteen entries, fitted in whole numbers.

A component x is the whole number floor(4096 * x); a vector is cut into ``PARTS`` equal parts. A part position's codebook starts as that
part of the ``ENTRIES`` first rows, and each of ``ROUNDS`` rounds assigns every part to its nearest entry and moves each entry to the floor of
the mean of its parts. All arithmetic is in whole numbers, so results are the same however rows are dealt out.

*Nearest entry.* A vantage-point tree over the entries of a part position: a node has an entry, and the entries nearer to it than the median
and the others as two branches, each with the least and largest distance of its entries. The distance to a node's entry, in whole
numbers, is what counts; a branch is looked into unless the triangle inequality rules it out. Radii and distances are square roots rounded outwards
by more than their error, and a branch that could only tie is visited, so the entry with the lowest index among the nearest is always found.
Rows of a batch walk the tree together, each row only where it must.

*Rounds.* Workers send sums and counts per part and entry: 128 rows a partition, which Spark adds up. The codebooks, 16 vectors, go through the driver.

Defined cases: rows whose vector is null or holds null or non-finite components take no part, all others do; a null id ranks
after all ids, rows of one id rank by their vectors; with fewer rows than entries the codebook is as short; vectors shorter than
the longest, or than a multiple of eight, count as followed by zeros; an entry that no part is nearest to stays; components beyond
``largest`` (whose distances do not fit 64 bits; some 32,768 for 64 components) raise an error; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, read

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: A branch with so few entries is compared entry by entry.
LEAF = 2
#: Square roots are rounded outwards by this share, far more than their error in doubles.
SLACK = 1e-12


def finite(v: Column) -> Column:
    """Not null, no null or non-finite component."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ok, F.lit(False))


def largest(width: int) -> int:
    """Whole numbers up to this have squared distances, summed over all parts, that fit 64 bits."""
    return math.isqrt((1 << 60) // (PARTS * width))


def whole(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, label, x: the rows that take part, as ``width`` whole numbers each."""
    cut = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall(cut, lambda x: F.abs(x) <= largest(width))
    ints = F.transform(cut, lambda x: x.cast("int"))
    padded = F.concat(ints, F.array_repeat(F.lit(0), F.lit(width) - F.size(ints)))
    return vectors.select("vec_id", "label", F.when(fits, padded).otherwise(F.raise_error(F.lit("a component is too large")).cast("array<int>")).alias("x"))


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one entry, as whole numbers."""
    gap = x - entry
    return (gap * gap).sum(1)


def low(square) -> np.ndarray:
    """No more than the square root."""
    return np.sqrt(np.asarray(square, np.float64)) * (1 - SLACK)


def high(square) -> np.ndarray:
    """No less than the square root."""
    return np.sqrt(np.asarray(square, np.float64)) * (1 + SLACK)


class Vantage:
    """The tree of one part position. ``nodes``: (entry, least and largest distance of the near branch, near, the same of the far branch, far), or a list of entries."""

    def __init__(self, book: np.ndarray):
        self.book = book.astype(np.int64)
        self.root = self._grow(list(range(len(book))))

    def _grow(self, entries: list[int]):
        if len(entries) <= LEAF:
            return entries
        point, rest = entries[0], entries[1:]
        d = squared(self.book[rest], self.book[point])
        order = np.argsort(d, kind="stable")
        half = (len(rest) + 1) // 2
        branches = []
        for part in (order[:half], order[half:]):
            branches.append((float(low(d[part[0]])), float(high(d[part[-1]])), self._grow([rest[i] for i in part])) if len(part) else None)
        return point, *branches

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; the lowest index of those that tie."""
        self.best = np.full(len(x), np.iinfo(np.int64).max)
        self.index = np.zeros(len(x), np.int64)
        self._visit(self.root, x.astype(np.int64), np.arange(len(x)))
        return self.index, self.best

    def _take(self, entry: int, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = squared(x[rows], self.book[entry])
        better = (d < self.best[rows]) | (d == self.best[rows]) & (entry < self.index[rows])
        self.best[rows[better]] = d[better]
        self.index[rows[better]] = entry
        return d

    def _visit(self, node, x: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, list):
            for e in node:
                self._take(e, x, rows)
            return
        point, near, far = node
        d = self._take(point, x, rows)
        least, most = low(d), high(d)
        inner = d <= (near[1] + far[0]) ** 2 / 4 if far else np.ones(len(d), bool)  # which branch a row looks into first; any choice is right
        for first, second, who in ((near, far, inner), (far, near, ~inner)):
            for branch in (first, second):
                if branch is not None:
                    # how near an entry of the branch can be at least, against the nearest so far
                    bound = np.maximum(least[who] - branch[1], branch[0] - most[who])
                    self._visit(branch[2], x, rows[who][bound <= high(self.best[rows[who]])])


def integers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def assigned(books: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts indexes, rows x parts squared distances); books is parts x entries x part width."""
    width = books.shape[2]
    got = [Vantage(books[p]).nearest(x[:, p * width : (p + 1) * width]) for p in range(len(books))]
    return np.stack([i for i, _ in got], 1), np.stack([d for _, d in got], 1)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the floor of the mean of the parts nearest to each entry."""
    parts, entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column("x")).astype(np.int64)
            index, _ = assigned(books, x)
            for p in range(parts):
                np.add.at(sums[p], index[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(index[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        if len(p):
            at = np.repeat(np.arange(len(p)), width)
            yield pa.RecordBatch.from_pydict({"part": p[at], "entry": e[at], "place": np.tile(np.arange(width), len(p)), "total": sums[p, e].ravel(), "n": counts[p, e][at]})

    got = rows.select("x").mapInArrow(run, "part long, entry long, place long, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in got.collect():  # a row for each number of the codebooks
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                index, far = assigned(books, integers(b.column("x")))
                code = [bytes(r).hex() for r in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def compress(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    v = vectors.select("vec_id", "label", "embedding").where(finite(F.col("embedding")))
    longest = v.agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    width = max(1, -(-(longest or 0) // PARTS))
    rows = scratch.table(whole(v, PARTS * width), "whole")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    if len(first):
        for _ in range(ROUNDS):
            books = moved(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = scratch.table(coded(rows, books), "codes")
    scratch.drop(rows)
    per = bounded(scratch.table(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels"))
    out = codes.join(per, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_codes(spark, sf_dir):
    return compress(read(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))


def op12_sql() -> str:
    """The same rounds as one query per round; vectors of one length, a multiple of eight."""
    near = "(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))))::bigint"
    parts = ["""kept as materialized (select row_number() over (order by vec_id, embedding) r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) v from embeddings
  where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))))""",
        "parts as materialized (select r, k, v[k * (len(v) // 8) + 1 : (k + 1) * (len(v) // 8)] v from kept cross join (select unnest(range(8)) k))",
        "book0 as materialized (select k, r - 1 e, v from parts where r <= 16)"]
    for i in range(ROUNDS + 1):
        parts.append(f"near{i} as materialized (select r, p.k, min([{near}, e]) best from parts p join book{i} c on c.k = p.k group by 1, 2)")
        if i < ROUNDS:
            mean = "list(m order by place)"
            parts.append(f"""book{i + 1} as materialized (select b.k, b.e, coalesce(n.v, b.v) v from book{i} b left join (select k, e, {mean} v from (select k, e, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) m from (
  select p.k, best[2] e, unnest(range(1, len(v) + 1)) place, unnest(v) x from parts p join near{i} n on n.r = p.r and n.k = p.k) group by 1, 2, 3) group by 1, 2) n on n.k = b.k and n.e = b.e)""")
    parts.append(f"codes as materialized (select r, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' order by k) code, sum(best[1])::bigint error from near{ROUNDS} group by 1)")
    sha = f"select sha256(string_agg(array_to_string(v, ','), ',' order by k, e)) from book{ROUNDS}"
    return f"with {', '.join(parts)} select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, ({sha}) codebooks_sha256 from kept join codes using (r)"
