"""Clusters of samples: principal components, average linkage, order of leaves, clusters, gender.

Components come from block power iteration: a round multiplies every exon's row with a block of vectors, one value a sample, and Spark
adds up the products, so that between rounds there is a matrix of samples x ``BLOCK`` and no matrix of samples x samples. The tree comes from a table of distances of
all pairs of samples: in each round every cluster finds its nearest, pairs that find each other are merged all at once, and one grouped
sum gives the distances of the merged. What is left is a node per sample; rules over the tree walk it once.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhelix.session import written

log = logging.getLogger(__name__)

MIN_SHARE, MAX_DIMS = 0.015, 20
START_SHARE, MAX_Z = 0.1, 3.0
#: Vectors that are iterated together; so many samples or fewer are done in one round.
BLOCK, MAX_ROUNDS = 64, 200
#: A component has settled when what the product adds to it is below this share of the largest.
SETTLED = 1e-9
#: So few clusters are merged without Spark.
FEW = 16
#: Leaves of the largest subtree whose order is the best of all; larger ones join their parts' orders end to end.
LEAVES = 2_048


def exon_rows(cells: DataFrame) -> DataFrame:
    """(ids, x): one row per exon, its values in the order of samples."""
    row = cells.groupBy("widx").agg(F.array_sort(F.collect_list(F.struct("s", "fpm"))).alias("v"))  # one entry per sample
    return row.select(F.transform("v", lambda q: q["s"]).alias("ids"), F.transform("v", lambda q: q["fpm"]).alias("x"))


def centred(batch: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    """Exons x samples, less the mean of each exon; an exon that lacks the value of a sample is an error."""
    own = np.asarray(batch.column("ids").flatten())
    if len(own) != batch.num_rows * len(ids) or (own.reshape(batch.num_rows, -1) != ids).any():
        raise ValueError("an exon lacks the value of a sample")
    x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
    return x - x.mean(1, keepdims=True)


def gram(cells: DataFrame) -> DataFrame:
    """(a, b, g): inner products of samples over centred exons, a <= b.

    Each partition multiplies its exons' rows with themselves, so that only one matrix a partition is shuffled. Every exon must have a value of every sample.
    """

    def run(batches):
        ids, total = None, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column("ids")[0].values) if ids is None else ids
            x = centred(b, ids)
            total = total + x.T @ x
        if ids is not None:
            i, j = np.triu_indices(len(ids))
            yield pa.RecordBatch.from_pydict({"a": pa.array(ids[i], pa.int32()), "b": pa.array(ids[j], pa.int32()), "g": total[i, j]})

    return exon_rows(cells).mapInArrow(run, "a int, b int, g double").groupBy("a", "b").agg(F.sum("g").alias("g"))


def product(rows: DataFrame, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(inner products of samples times q, sum of squares of all values): each partition sends samples x columns of q, which Spark adds up."""
    width = q.shape[1]
    names = [f"y{k}" for k in range(width)]
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        own, v = shared.value
        total, squares = np.zeros(v.shape), 0.0
        for b in batches:
            if b.num_rows:
                x = centred(b, own)
                total += x.T @ (x @ v)
                squares += float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(own))), *[pa.array(np.append(squares, total[:, k])) for k in range(v.shape[1])]], names=["i", *names])

    t = rows.mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    shared.unpersist()
    t = t.sort_by("i")
    y = np.stack([np.asarray(t.column(c)) for c in names], 1)
    return y[1:], float(y[0, 0])


@dataclass
class Space:
    """Samples in the space of their leading components."""

    ids: np.ndarray
    scores: np.ndarray
    #: Of up to ``MAX_DIMS`` components, those that ``scores`` has and those left out.
    share: np.ndarray


def principal(cells: DataFrame, block: int = BLOCK) -> Space:
    """Scores of the leading components above the least share, and explained shares of all that count."""
    rows = written(exon_rows(cells), "exons")
    first = rows.select("ids").first()
    if first is None:
        return Space(np.zeros(0, int), np.zeros((0, 0)), np.zeros(0))
    ids, exons = np.array(first["ids"]), rows.count()
    n = len(ids)
    most = max(1, min(MAX_DIMS, exons - 1, n - 1))
    q = np.eye(n) if n <= block else np.linalg.qr(np.random.default_rng(0).normal(size=(n, block)))[0]
    for _ in range(MAX_ROUNDS):
        y, total = product(rows, ids, q)
        values, turn = np.linalg.eigh(q.T @ y)
        order = np.argsort(-values)[:most]
        values, vectors, rest = np.maximum(values[order], 0), q @ turn[:, order], y @ turn[:, order]
        share = values / max(total, 1e-300)
        keep = int(np.argmin(np.append(share > MIN_SHARE, False))) or most
        off = np.linalg.norm(rest - vectors * values, axis=0)
        # the next one stays below the least share, as an eigenvalue lies within ``off`` of it
        undecided = keep < most and share[keep] <= MIN_SHARE < (values[keep] + off[keep]) / max(total, 1e-300)
        if n <= block or off[:keep].max() <= SETTLED * max(values[0], 1e-300) and not undecided:
            break
        q = np.linalg.qr(y)[0]
    else:
        log.warning("components have not settled after %d rounds", MAX_ROUNDS)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return Space(ids, (vectors * signs * np.sqrt(values))[:, :keep], share)


def distances(spark: SparkSession, points: np.ndarray) -> DataFrame:
    """(a, b, d): Euclidean distances of all pairs of rows, a < b; an average over pairs needs each of them."""
    shared = spark.sparkContext.broadcast(points)  # samples x MAX_DIMS

    def run(batches):
        p = shared.value
        for batch in batches:
            for a in np.asarray(batch.column("id")).tolist():
                d = np.sqrt(((p[a + 1 :] - p[a]) ** 2).sum(1))
                yield pa.RecordBatch.from_pydict({"a": np.full(len(d), a), "b": np.arange(a + 1, len(p)), "d": d})

    return spark.range(max(len(points) - 1, 0)).mapInArrow(run, "a long, b long, d double")


def tree_by_rounds(spark: SparkSession, points: np.ndarray, few: int = FEW) -> list[tuple[int, int, float, int]]:
    """Average linkage as ``linkage`` gives it, by rounds of mutual nearest neighbours over the table of distances.

    Merging all mutual neighbours of a round at once gives the tree that merging the nearest pair again and again does, as an average is never below both of its
    parts. Of equally near clusters the one with the lowest number is nearest.
    """
    n = len(points)
    merges: list[tuple[int, int, float]] = []  # children by number, distance; the node gets the next number
    size = dict.fromkeys(range(n), 1)
    grew = [1] * n  # sizes of all nodes
    pairs = None
    while len(size) > max(few, 1):
        if pairs is None:
            pairs = written(distances(spark, points), "distances")
        both = pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        near = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b", "m.d").toArrow()  # a row per cluster
        nearest = {a: (b, d) for a, b, d in zip(*(near.column(c).to_pylist() for c in ("a", "b", "d")), strict=True)}
        moved = []
        for a, (b, d) in sorted(nearest.items()):
            if a < b and nearest[b][0] == a:
                k = n + len(merges)
                merges.append((a, b, d))
                size[k] = size.pop(a) + size.pop(b)
                grew.append(size[k])
                moved += [(c, k, grew[c] / grew[k]) for c in (a, b)]
        to = spark.createDataFrame(moved, "c long, k long, w double")
        side = lambda c, k, w: F.broadcast(to.select(F.col("c").alias(c), F.col("k").alias(k), F.col("w").alias(w)))
        new = pairs.join(side("a", "ka", "wa"), "a", "left").join(side("b", "kb", "wb"), "b", "left")
        one = F.lit(1.0)
        new = new.select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"), (F.col("d") * F.coalesce("wa", one) * F.coalesce("wb", one)).alias("d")).where("x <> y")
        new = new.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("d").alias("d"))
        pairs = written(new, "distances")
    left = sorted(size)
    if len(left) > 1:
        at = {c: i for i, c in enumerate(left)}
        d = np.full((len(left), len(left)), np.inf)
        if pairs is None:
            d[:, :] = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
        else:
            for r in pairs.collect():  # pairs of a few clusters
                d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["d"]
        names = list(left)
        for a, b, dist, _ in linked(d, np.array([size[c] for c in left])):
            names.append(n + len(merges))
            merges.append((names[a], names[b], dist))
    return in_order(merges, n)


def in_order(merges: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, int]]:
    """(child, child, distance, size) of nodes numbered by rising distance, children before parents."""
    height, size = [0.0] * n, [1] * n
    for a, b, d in merges:
        height.append(max(d, height[a], height[b]))
        size.append(size[a] + size[b])
    order = sorted(range(n, n + len(merges)), key=lambda k: (height[k], k))
    number = {**{i: i for i in range(n)}, **{k: n + i for i, k in enumerate(order)}}
    return [(*sorted((number[merges[k - n][0]], number[merges[k - n][1]])), merges[k - n][2], size[k]) for k in order]


def linkage(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Average linkage over Euclidean distances: (child, child, distance, size) of each new node."""
    return linked(np.sqrt(np.maximum(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1), 0)), np.ones(len(points)))


def linked(d: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Average linkage of clusters of given sizes over their matrix of distances, the nearest pair again and again."""
    n = len(d)
    full = np.full((2 * n, 2 * n), np.inf)
    full[:n, :n] = d
    np.fill_diagonal(full, np.inf)
    size, out = np.append(sizes, np.ones(n)), []
    least, at = full.min(1), full.argmin(1)  # of each live row
    for k in range(n, 2 * n - 1):
        i = int(np.argmin(least))
        a, b = sorted((i, int(at[i])))
        size[k] = size[a] + size[b]
        out.append((a, b, float(full[a, b]), int(size[k])))
        row = (size[a] * full[a, :] + size[b] * full[b, :]) / size[k]
        row[[a, b, k]] = np.inf
        full[k, :], full[:, k] = row, row
        full[[a, b], :], full[:, [a, b]] = np.inf, np.inf
        least[[a, b]] = np.inf
        stale = np.flatnonzero(np.isin(at, (a, b)) & np.isfinite(least))
        least[stale], at[stale] = full[stale].min(1), full[stale].argmin(1)
        nearer = row < least
        least[nearer], at[nearer] = row[nearer], k
        least[k], at[k] = row.min(), row.argmin()
    return out


def leaf_order(tree, points: np.ndarray, most: int = LEAVES) -> list[int]:
    """Leaves in the order, among those that swapping children of nodes can give, in which the distances of neighbours sum to the least.

    Of every subtree the least sum is kept for each pair of an outermost left and right leaf, one from either child, as the least over the two leaves that meet in the
    middle. A node of more than ``most`` leaves joins the orders of its children where the nearest two ends meet.
    """
    n = len(points)
    if n == 0:
        return []
    leaves: dict[int, np.ndarray] = {i: np.array([i]) for i in range(n)}
    best: dict[int, np.ndarray] = {i: np.zeros((1, 1)) for i in range(n)}  # leaves x leaves, infinite for two of one child
    fixed: dict[int, list[int]] = {}
    far = lambda a, b: np.sqrt(((points[a][:, None, :] - points[b][None, :, :]) ** 2).sum(-1))
    kids = {n + i: (a, b) for i, (a, b, _, _) in enumerate(tree)}

    def unrolled(node: int, left: int | None, right: int | None) -> list[int]:
        """The leaves of a node's best order between two given ends, or between the best ones."""
        out, todo = [], [(node, left, right)]
        while todo:
            v, i, j = todo.pop()
            if v < n:
                out.append(v)
                continue
            own = leaves[v]
            if i is None:
                x, y = np.unravel_index(np.argmin(best[v]), best[v].shape)
                i, j = int(own[x]), int(own[y])
            a, b = kids[v]
            if i not in where[a]:
                a, b = b, a
            middle = best[a][where[a][i]][:, None] + far(leaves[a], leaves[b]) + best[b][:, where[b][j]][None, :]
            k, m = np.unravel_index(np.argmin(middle), middle.shape)
            todo += [(b, int(leaves[b][m]), j), (a, i, int(leaves[a][k]))]
        return out

    where: dict[int, dict[int, int]] = {i: {i: 0} for i in range(n)}
    last = n - 1
    for v, (a, b) in kids.items():
        last = v
        if a in fixed or b in fixed or len(leaves[a]) + len(leaves[b]) > most:
            parts = [fixed.pop(c) if c in fixed else unrolled(c, None, None) for c in (a, b)]
            for c in (a, b):
                leaves.pop(c, None), best.pop(c, None)
            x, y = parts
            turns = [(p, q) for p in (x, x[::-1]) for q in (y, y[::-1])] + [(q, p) for p in (x, x[::-1]) for q in (y, y[::-1])]
            p, q = min(turns, key=lambda t: float(((points[t[0][-1]] - points[t[1][0]]) ** 2).sum()))
            fixed[v] = p + q
            continue
        d, left, right = far(leaves[a], leaves[b]), best[a], best[b]
        half = np.stack([(row[:, None] + d).min(0) for row in left])  # from each left end to each leaf of b that meets a
        across = np.stack([(row[:, None] + right).min(0) for row in half])
        k = len(leaves[a])
        whole = np.full((k + len(leaves[b]),) * 2, np.inf)
        whole[:k, k:], whole[k:, :k] = across, across.T
        leaves[v], best[v] = np.concatenate([leaves[a], leaves[b]]), whole
        where[v] = {int(leaf): i for i, leaf in enumerate(leaves[v])}
    return fixed[last] if last in fixed else unrolled(last, None, None)


def branch_scores(tree, n: int, min_size: int):
    """Of each node to its parent: how many spreads the branch is longer than those below it; weighed for small nodes."""
    height = {**dict.fromkeys(range(n), 0.0), **{n + i: t[2] for i, t in enumerate(tree)}}
    below: dict[int, tuple[int, float, float]] = dict.fromkeys(range(n), (0, 0.0, 0.0))  # number, mean and sum of squares about it of the branches
    z = {}

    def both(x, y):
        k = x[0] + y[0]
        if not k:
            return x
        gap = y[1] - x[1]
        return k, x[1] + gap * y[0] / k, x[2] + y[2] + gap * gap * x[0] * y[0] / k

    for i, (a, b, dist, _) in enumerate(tree):
        gathered = (0, 0.0, 0.0)
        for c in (a, b):
            length, (k, mean, squares) = dist - height[c], below[c]
            if c < n or k < 2:
                z[c] = 0.0
            else:
                weight = max(min_size / tree[c - n][3], 1)
                z[c] = (length - weight * mean) / (np.sqrt(squares / (k - 1)) + 1)
            gathered = both(gathered, both((1, length, 0.0), below[c]))
        below[n + i] = gathered
    return z


def clusters_of(tree, n: int, min_size: int):
    """[(samples, numbers of clusters to fit with)], largest first.

    A node of the tree either joins both children into one open cluster, or keeps them apart; then it is
    virtual, and a child that was willing to join takes its brother's clusters as partners to fit with.
    """
    z, near = branch_scores(tree, n, min_size), START_SHARE * tree[-1][2] if tree else 0.0
    own: dict[int, list[int] | None] = {i: [i] for i in range(n)}
    fit: dict[int, list[int]] = {i: [] for i in range(n)}
    for i, (a, b, dist, _) in enumerate(tree):
        k, size = n + i, lambda c: 1 if c < n else tree[c - n][3]
        wants = {c: dist <= near or (not fit[c] and z[c] <= MAX_Z) for c in (a, b)}
        for c, other in ((a, b), (b, a)):
            if wants[other] and not wants[c] and not fit[c] and size(c) < min_size:
                wants[c] = True
        if all(wants.values()):
            own[k], fit[k] = own.pop(a) + own.pop(b), []
            own[a] = own[b] = None
            continue
        theirs = {c: fit[c] + [c] * bool(own[c]) for c in (a, b)}
        own[k], fit[k] = None, theirs[a] + theirs[b]
        for c, other in ((a, b), (b, a)):
            if wants[c]:
                fit[c] = fit[c] + theirs[other]
    order = sorted((c for c in own if own[c]), key=lambda c: (-len(own[c]), c))
    number = {c: j for j, c in enumerate(order)}
    return [(sorted(own[c]), sorted(number[f] for f in fit[c])) for c in order]


def validity(clusters, min_size: int):
    """[(valid, valid clusters to fit with)]: sizes with those of valid partners reach the least size."""
    ok: dict[int, bool] = {}
    for c in sorted(range(len(clusters)), key=lambda c: (len(clusters[c][1]), c)):
        own, fit = clusters[c]
        ok[c] = len(own) + sum(len(clusters[f][0]) for f in fit if ok.get(f)) >= min_size
    return [(ok[c], [f for f in clusters[c][1] if ok[f]]) for c in range(len(clusters))]


@dataclass
class Grown:
    """The samples' space and the tree over them."""

    spark: SparkSession
    space: Space
    tree: list[tuple[int, int, float, int]]

    def table(self, rows: list, schema: str) -> DataFrame:
        """Rows of nodes or samples."""
        return self.spark.createDataFrame(rows, schema)


def grown(cells: DataFrame, few: int = FEW) -> Grown:
    space = principal(cells)
    return Grown(cells.sparkSession, space, tree_by_rounds(cells.sparkSession, space.scores, few))


def pca(cells: DataFrame | Grown) -> DataFrame:
    """(s, dim, score, share)."""
    space = cells.space if isinstance(cells, Grown) else principal(cells)
    spark = cells.spark if isinstance(cells, Grown) else cells.sparkSession
    rows = [(int(s), j, float(space.scores[i, j]), float(space.share[j])) for i, s in enumerate(space.ids) for j in range(space.scores.shape[1])]
    return spark.createDataFrame(rows, "s int, dim int, score double, share double")


def tree_of(g: Grown) -> DataFrame:
    """(node, s, c1, c2, dist, size, place): leaves with their sample and place in the best order, nodes with their children and the first place of their leaves."""
    order = leaf_order(g.tree, g.space.scores)
    place = {leaf: i for i, leaf in enumerate(order)}
    rows = [(i, int(s), None, None, 0.0, 1, place[i]) for i, s in enumerate(g.space.ids)]
    for i, (a, b, dist, size) in enumerate(g.tree):
        k = len(g.space.ids) + i
        place[k] = min(place[a], place[b])
        rows.append((k, None, *sorted((a, b), key=place.get), dist, size, place[k]))
    return g.table(rows, "node int, s int, c1 int, c2 int, dist double, size int, place int")


def branch_table(g: Grown, min_size: int) -> DataFrame:
    z = branch_scores(g.tree, len(g.space.ids), min_size)
    return g.table([(int(k), float(v)) for k, v in sorted(z.items())], "node int, z double")


def _named(g: Grown, kind: str, min_size: int):
    """[(name, samples by number, names to fit with, valid)]."""
    found = clusters_of(g.tree, len(g.space.ids), min_size)
    name = [f"{kind}_{j + 1:02d}" for j in range(len(found))]
    return [(name[j], own, [name[f] for f in fit], v) for j, ((own, _), (v, fit)) in enumerate(zip(found, validity(found, min_size), strict=True))]


def clusters(g: Grown, kind: str, min_size: int) -> DataFrame:
    """(cluster_id, fit_with, valid, s): a row per sample."""
    rows = [(name, ",".join(fit), bool(v), int(g.space.ids[i])) for name, own, fit, v in _named(g, kind, min_size) for i in own]
    return g.table(rows, "cluster_id string, fit_with string, valid boolean, s int")


def dendrogram(g: Grown, kind: str, min_size: int) -> DataFrame:
    """(node, c1, c2, size, place, cluster_id) of inner nodes, children in the order of their leaves: the cluster that holds all samples of a node, ``V`` where there are several."""
    of = {i: name for name, own, _, _ in _named(g, kind, min_size) for i in own}
    rows = []
    for i, (a, b, _, _) in enumerate(g.tree):
        of[len(g.space.ids) + i] = of[a] if of[a] == of[b] else "V"
        rows.append((len(g.space.ids) + i, of[len(g.space.ids) + i]))
    return tree_of(g).where("s is null").select("node", "c1", "c2", "size", "place").join(F.broadcast(g.table(rows, "node int, cluster_id string")), "node")  # a row per node


def gender(cells: DataFrame, accepted: DataFrame, membership: DataFrame, compat: bool = False) -> DataFrame:
    """(cluster_id, med_x, med_y, gender): F where the median sum on Y or W is at most the middle of the first large gap.

    With no large gap all are F; ``compat`` keeps the historic answer, M, where the least median is not 0.
    """
    x = cells.join(accepted.select("widx"), "widx", "left_semi").groupBy("s").agg(F.sum("fpm").alias("sx"))
    y = cells.where("chrom in ('chrY', 'Y', 'chrW', 'W')").groupBy("s").agg(F.sum("fpm").alias("sy"))
    per = membership.join(x, "s", "left").join(y, "s", "left").groupBy("cluster_id").agg(F.percentile(F.coalesce("sx", F.lit(0.0)), 0.5).alias("med_x"), F.percentile(F.coalesce("sy", F.lit(0.0)), 0.5).alias("med_y"))
    return per.crossJoin(F.broadcast(first_gap(per, compat))).withColumn("gender", F.when(F.col("med_y") <= F.col("threshold"), "F").otherwise("M")).drop("threshold")


def first_gap(per: DataFrame, compat: bool = False, large: float = 200.0) -> DataFrame:
    """One row (threshold): the middle of the first gap over ``large`` among sorted medians, from 0 on."""
    by = Window.orderBy("med_y", "cluster_id")  # one row per cluster
    gaps = per.select("med_y", F.lag("med_y", 1, 0.0).over(by).alias("below"))
    none = F.lit(0.0) if compat else F.lit(float("inf"))
    return gaps.where(F.col("med_y") - F.col("below") > large).agg(F.coalesce(F.min((F.col("med_y") + F.col("below")) / 2), none).alias("threshold"))
