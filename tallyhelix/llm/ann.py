"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (at most about ``SAMPLE`` rows, by a hash of vec_id) of unit
vectors; every row is put into its leaf. A query walks the tree with a priority queue: the nearest
unopened node is opened next, and leaves are visited in that order. How many leaves is calibrated:
visits widen until sampled queries, searched in the sample, reach ``RECALL`` of their true
neighbours. Leaves and the queries that visit them meet in groups of (leaf, part), with as many parts
as a leaf's size asks for, so a crowded leaf is no single task.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those of another length than the commonest; candidates never include rows with the query's own id;
a row that repeats counts once; ties go to the smaller vec_id; with fewer than k candidates in reach
of all leaves, all are returned; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read

SAMPLE = 16_384
BRANCH = 12
#: Nodes with fewer sampled rows are leaves; so is every node at this depth.
LEAF, DEPTH = 48, 3
RECALL = 0.97
#: Rows of a leaf, and of its queries, in one part.
PART = 4096
EVERY = 50


def sound(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as float64."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, the same for equal rows wherever they stand."""
    top = np.abs(m).max(1, keepdims=True)
    q, m = q / np.abs(q).max(), m / top
    return (m * q).sum(1) / (np.sqrt((m * m).sum(1)) * np.sqrt((q * q).sum()))


class Tree:
    """Centres of inner nodes; ``child[i]`` is a node, or a leaf number coded as -1 - leaf."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.centres: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(x, 0, rng)

    def _grow(self, x, depth, rng) -> int:
        node = len(self.centres)
        self.centres.append(None)
        self.child.append([])
        kinds = np.unique(x, axis=0)
        k = min(BRANCH, len(kinds))
        c = kinds[rng.choice(len(kinds), k, replace=False)] if k else np.zeros((1, x.shape[1]))
        for _ in range(8):
            own = (x @ c.T).argmax(1) if len(x) else np.zeros(0, int)
            new = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
            size = np.linalg.norm(new, axis=1, keepdims=True)
            new = np.where(size > 1e-9, new / np.maximum(size, 1e-9), c)
            if np.allclose(new, c):
                break
            c = new
        self.centres[node] = c
        own = (x @ c.T).argmax(1) if len(x) else np.zeros(0, int)
        for j in range(len(c)):
            part = x[own == j]
            if depth + 1 >= DEPTH or len(part) < LEAF or len(np.unique(part, axis=0)) < 2:
                self.child[node].append(-1 - self.leaves)
                self.leaves += 1
            else:
                self.child[node].append(self._grow(part, depth + 1, rng))
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            own = (x[at] @ self.centres[node].T).argmax(1)
            for j, c in enumerate(self.child[node]):
                part = at[own == j]
                if c < 0:
                    out[part] = -1 - c
                elif len(part):
                    todo.append((c, part))
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The leaves in best-bin-first order."""
        queue, out, n = [(0.0, 0, 0)], [], 1
        while queue and len(out) < leaves:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            for far, c in zip((-(self.centres[node] @ q)).tolist(), self.child[node], strict=True):
                heapq.heappush(queue, (far, n, c))
                n += 1
        return out

    def calibrate(self, x: np.ndarray, k: int, queries: int = 256) -> int:
        """The fewest leaves with which queries from the sample find ``RECALL`` of their k nearest in it."""
        if len(x) < 2:
            return self.leaves
        leaf, asked = self.leaf_of(x), np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
        need = []
        for i in asked.tolist():
            s = x @ x[i]
            s[i] = -2
            best = np.argpartition(-s, min(k, len(s) - 1))[:k]
            at = {v: j for j, v in enumerate(self.visit(x[i], self.leaves), 1)}
            need += [at[v] for v in leaf[best].tolist()]
        need.sort()
        return need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]


def nearest(vectors: DataFrame, scratch: Scratch, k: int = 5, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    sizes = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return empty
    v = scratch.table(v.where(F.size("embedding") == sizes["d"]).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct(), "vectors")
    share = min(1.0, SAMPLE / sizes["n"])
    place = F.pmod(F.xxhash64("vec_id", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    t = v.where(place < share).toArrow()  # the bounded sample
    if not t.num_rows:
        t = v.limit(SAMPLE).toArrow()
    t = t.sort_by("vec_id").combine_chunks()
    x = unit(matrix(t.column("embedding").combine_chunks()))
    tree = Tree(x)
    visits = tree.calibrate(x, k)
    shared = spark.sparkContext.broadcast(tree)  # at most BRANCH ** DEPTH centres

    def place_rows(batches):
        for b in batches:
            if b.num_rows:
                leaf = shared.value.leaf_of(unit(matrix(b.column("embedding"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    def place_queries(most: int):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    q = unit(matrix(b.column("embedding")))
                    leaves = pa.array([shared.value.visit(r, most) for r in q], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*b.columns, leaves], names=["vec_id", "embedding", "leaves"])

        return run

    rows = scratch.table(v.mapInArrow(place_rows, "vec_id long, embedding array<double>, leaf long"), "rows")
    queries = v.where(F.col("vec_id") % every == 0)

    def search(queries: DataFrame, leaves: int) -> DataFrame:
        asked = queries.mapInArrow(place_queries(leaves), "vec_id long, embedding array<double>, leaves array<long>")
        return found_in(rows, scratch.table(asked.select("vec_id", "embedding", F.explode("leaves").alias("leaf")), "asked"), scratch, k)

    found = scratch.table(search(queries, visits), "found")
    # queries whose leaves hold fewer than k others look through all leaves
    enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = scratch.table(queries.join(enough, "vec_id", "left_anti"), "few")
    if visits < tree.leaves and not few.isEmpty():
        found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(search(few, tree.leaves))
    return found.select("query_id", "rank", "vec_id", "score")


def found_in(rows: DataFrame, asked: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows in the leaves that each query visits."""
    # one row per leaf: at most BRANCH ** DEPTH of them
    parts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("sheets")), "leaf")
    parts = F.broadcast(scratch.table(parts, "parts"))
    rows = rows.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int")).withColumn("sheet", F.explode(F.sequence(F.lit(0), F.col("sheets") - 1)))
    asked = asked.join(parts, "leaf").withColumn("sheet", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("sheets")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.asarray(left.column("vec_id")) if left.num_rows else np.zeros(0, np.int64)
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(ids) and right.num_rows:
            m = matrix(left.column("embedding").combine_chunks())
            u = unit(m)
            q = matrix(right.column("embedding").combine_chunks())
            uq = unit(q)
            for a in range(0, len(q), 512):
                s = uq[a : a + 512] @ u.T
                for i, qid in enumerate(right.column("vec_id").slice(a, 512).to_pylist()):
                    row = np.where(ids == qid, -9.0, s[i])
                    near = np.flatnonzero(row >= (np.partition(row, -k)[-k] if len(row) > k else -2) - 1e-9)
                    near = near[ids[near] != qid]
                    exact = cosine(q[a + i], m[near]) if len(near) else np.zeros(0)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out["query_id"] += [qid] * len(best)
                    out["vec_id"] += ids[near][best].tolist()
                    out["score"] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    both = rows.select("leaf", "part", "sheet", "vec_id", "embedding").groupBy("leaf", "part", "sheet").cogroup(asked.select("leaf", "part", "sheet", "vec_id", "embedding").groupBy("leaf", "part", "sheet"))
    found = both.applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))
