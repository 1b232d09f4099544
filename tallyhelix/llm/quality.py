"""Quality of texts by a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: its words (runs without white space, A-Z lower-cased) hashed into ``BUCKETS``, each with
log(1 + count), scaled to length one; statistics of its structure (lengths, shares of upper case, digits, signs, line ends and characters
beyond ASCII, words that repeat or end in signs), scaled by the sample's mean and spread; and from its metadata the power of two
below ``n_chars``. Every feature i has a weight w_i and a vector v_i of ``RANK`` numbers; the score is the logistic curve of

    w_0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where the sum over all pairs is half of (sum_i v_i x_i) ** 2 - sum_i v_i ** 2 x_i ** 2 in each of the ``RANK`` dimensions, so a
document is scored in time linear in its features.

The machine is fitted by adaptive gradient steps on at most about ``SAMPLE`` labelled rows of each class, chosen by a hash of
doc_id among rows whose crc32(doc_id) mod 3 is not 1; rows weigh as much as their class has labels. Every document is
scored over its whole text; long texts are counted piece by piece.

Defined cases: a null text is an empty one; empty texts have no words and a score from their structure; a null ``n_chars`` or
one below 1, and a table without that column, add nothing; rows with null labels are not learned from; of repeated labels of one id the largest
holds; where a class has no sampled row, the score is 0.5; rows of one text and ``n_chars`` get one score; repeated rows and null ids
are scored like others; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read
from .hashing import space_bytes, words, words_at
from .toxicity import held_out
from .words import slices

#: Buckets of words, powers of two of the metadata, dimensions of a feature's vector.
BUCKETS, POWERS, RANK = 1 << 13, 40, 8
#: Sampled rows of class 0 and 1.
SAMPLE = (4_000, 4_000)
#: Passes over the sample, rows of one step, size of a step, and pull of weights and vectors towards zero.
PASSES, STEP_ROWS, STEP, RIDGE = 12, 128, 0.1, 1e-5
LIMIT = 0.5
#: Bytes of text that a worker takes at a time; a longer text is taken in pieces of about this size.
AT_ONCE = 1 << 19
#: What is counted in the bytes of a text, and the statistics made of it.
SUMS = ("bytes", "words", "upper", "digits", "signs", "lines", "wide", "repeats", "signed", "distinct", "squares")
STATISTICS = 12
WIDTH = BUCKETS + STATISTICS + POWERS


def _classes() -> np.ndarray:
    """Of each byte: which of upper, digits, signs, lines, wide it counts for."""
    b = np.arange(256)
    upper, digit, wide, line = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), b >= 128, b == 10
    sign = (b > 32) & (b < 127) & ~upper & ~digit & ~((b >= 97) & (b <= 122))
    return np.stack([upper, digit, sign, line, wide], 1).astype(np.int64)


CLASSES = _classes()


def pieces(raw: bytes):
    """The text in runs of about ``AT_ONCE`` bytes, cut before a space."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + AT_ONCE) if len(raw) - at > AT_ONCE else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def tallied(raw: list[bytes]):
    """(text, bucket, count) of the words of short texts, and a row of ``SUMS`` for each text without the last two."""
    n = len(raw)
    sums = np.zeros((n, len(SUMS)), np.int64)
    kind, start, end, doc = words_at(raw, space_bytes())
    h, _ = words(raw, space_bytes())
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in raw], np.int64)
    sums[:, 0] = sizes
    whose = np.repeat(np.arange(n), sizes + 1)
    per = np.bincount(whose * 256 + buf, minlength=256 * n).reshape(n, 256)
    per[:, 10] -= 1  # the line end that parts the texts
    sums[:, 2:7] = per @ CLASSES
    sums[:, 1] = np.bincount(doc, minlength=n)
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    sums[:, 7] = np.bincount(doc[1:][again], minlength=n)
    sums[:, 8] = np.bincount(doc, CLASSES[buf[end - 1], 2], n)
    key, count = np.unique(doc * BUCKETS + (h >> np.uint64(51)).astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count, sums


def vectors(raw: list[bytes], chars: np.ndarray):
    """(row, feature, value) in order of rows, statistics not yet scaled: the sparse vectors of texts."""
    short = [t if len(t) <= AT_ONCE else b"" for t in raw]
    row, bucket, count, sums = tallied(short)
    for i in np.flatnonzero([len(t) > AT_ONCE for t in raw]).tolist():
        held = np.zeros(BUCKETS, np.int64)
        for p in pieces(raw[i]):
            _, b, c, s = tallied([p])
            held[b] += c
            sums[i] += s[0]
        b = np.flatnonzero(held)
        row, bucket, count = np.append(row, np.full(len(b), i)), np.append(bucket, b), np.append(count, held[b])
    n = len(raw)
    sums[:, 9] = np.bincount(row, minlength=n)
    sums[:, 10] = np.bincount(row, count.astype(float) ** 2, n)
    value = np.log1p(count)
    value = value / np.sqrt(np.maximum(np.bincount(row, value * value, n), 1e-12))[row]
    s = sums.astype(float).T
    size, number = s[:2]
    per_byte, per_word = np.maximum(size, 1), np.maximum(number, 1)
    stats = np.stack([np.log1p(size), np.log1p(number), size / per_word, *(s[2:7] / per_byte), s[7] / per_word, s[8] / per_word, s[10] / per_word**2, s[9] / np.minimum(per_word, BUCKETS)], 1)
    known = np.flatnonzero(chars >= 1)
    power = BUCKETS + STATISTICS + np.minimum(np.log2(np.maximum(chars[known], 1)).astype(np.int64), POWERS - 1)
    row = np.concatenate([row, np.repeat(np.arange(n), STATISTICS), known])
    feature = np.concatenate([bucket, np.tile(BUCKETS + np.arange(STATISTICS), n), power])
    value = np.concatenate([value, stats.ravel(), np.ones(len(known))])
    order = np.lexsort((feature, row))
    return row[order], feature[order], value[order]


class Machine:
    """w_0, weights, vectors, and the mean and spread of the statistics."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bias, self.weight, self.vector = 0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK))
        self.mean, self.spread = np.zeros(STATISTICS), np.ones(STATISTICS)

    def scaled(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The values, statistics as numbers of spreads from the mean, at most five, together about as long as the words."""
        at = feature - BUCKETS
        is_stat = (at >= 0) & (at < STATISTICS)
        k = at[is_stat]
        out = value.copy()
        out[is_stat] = np.clip((value[is_stat] - self.mean[k]) / self.spread[k], -5, 5) / np.sqrt(STATISTICS)
        return out

    def raw(self, row, feature, value, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(the sums under the curve, sum_i v_i x_i of each row); values are scaled."""
        linear = self.bias + np.bincount(row, self.weight[feature] * value, n)
        vx = self.vector[feature] * value[:, None]
        total = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(row, (vx * vx).sum(1), n)
        return linear + 0.5 * ((total * total).sum(1) - squares), total

    def score(self, row, feature, value, n: int) -> np.ndarray:
        z, _ = self.raw(row, feature, self.scaled(feature, value), n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, row, feature, value, y: np.ndarray, weight: np.ndarray, seed: int = 1) -> None:
        """Adaptive gradient steps on the weighted log-likelihood; rows are numbered from 0 in order."""
        n = len(y)
        stats = np.zeros((n, STATISTICS))
        at = feature - BUCKETS
        is_stat = (at >= 0) & (at < STATISTICS)
        stats[row[is_stat], at[is_stat]] = value[is_stat]
        self.mean, self.spread = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        value = self.scaled(feature, value)
        share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        first = np.searchsorted(row, np.arange(n + 1))
        grad_w, grad_v, grad_b = np.full(WIDTH, 1e-8), np.full((WIDTH, RANK), 1e-8), 1e-8
        rng = np.random.default_rng(seed)
        for _ in range(PASSES):
            order = rng.permutation(n)
            for a in range(0, n, STEP_ROWS):
                rows = order[a : a + STEP_ROWS]
                size = first[rows + 1] - first[rows]
                pick = np.repeat(first[rows] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                own, f, x = np.repeat(np.arange(len(rows)), size), feature[pick], value[pick]
                z, total = self.raw(own, f, x, len(rows))
                miss = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                kinds, back = np.unique(f, return_inverse=True)
                g = np.bincount(back, miss[own] * x) + RIDGE * self.weight[kinds]
                grad_w[kinds] += g * g
                pull = miss[own, None] * x[:, None] * (total[own] - self.vector[f] * x[:, None])
                gv = np.stack([np.bincount(back, pull[:, k]) for k in range(RANK)], 1) + RIDGE * self.vector[kinds]
                grad_v[kinds] += gv * gv
                gb = miss.sum()
                grad_b += gb * gb
                self.weight[kinds] -= STEP * g / np.sqrt(grad_w[kinds])
                self.vector[kinds] -= STEP * gv / np.sqrt(grad_v[kinds])
                self.bias -= STEP * gb / np.sqrt(grad_b)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, chars."""
    chars = F.col("n_chars").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(chars, F.lit(0.0)).alias("chars"))


def learn(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine fitted on the sample, or None where a class has no sampled row."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).where(~held_out())
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, min(1.0, SAMPLE[1] / n[1])).otherwise(min(1.0, SAMPLE[0] / n[0]))
    # at most about the sum of SAMPLE rows of twelve bytes, so texts need no shuffle
    sample = _texts(docs).join(F.broadcast(known.where(place < share)), "doc_id").select(F.xxhash64("doc_id").alias("order"), "y", "text", "chars")

    def run(batches):
        for b in batches:
            chars = np.asarray(b.column("chars"))
            for a, z, texts in slices(b.column("text"), AT_ONCE):
                row, feature, value = vectors(texts, chars[a:z])
                cut = pa.array(np.searchsorted(row, np.arange(z - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(c)) for c in (feature.astype(np.int16), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("order").slice(a, z - a), b.column("y").slice(a, z - a), *lists], names=["order", "y", "feature", "value"])

    # at most the sample's rows, each of at most WIDTH features of six bytes
    t = sample.mapInArrow(run, "order long, y int, feature array<smallint>, value array<float>").toArrow()
    t = t.sort_by([("order", "ascending"), ("y", "ascending")]).combine_chunks()
    y = np.asarray(t.column("y")).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    lists = t.column("feature").combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    feature, value = np.asarray(lists.flatten()).astype(np.int64), np.asarray(t.column("value").combine_chunks().flatten()).astype(float)
    weight = np.where(y == 1, n[1] / y.sum(), n[0] / (1 - y).sum())
    machine = Machine()
    machine.fit(np.repeat(np.arange(len(y)), size), feature, value, y, weight / weight.mean())
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    texts = _texts(docs)
    if machine is None:
        out = texts.select("doc_id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(machine)  # WIDTH x (RANK + 1) numbers

        def run(batches):
            for b in batches:
                chars = np.asarray(b.column("chars"))
                for a, z, raw in slices(b.column("text"), AT_ONCE):
                    p = np.round(shared.value.score(*vectors(raw, chars[a:z]), z - a), 9)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), pa.array(p)], names=["doc_id", "score"])

        out = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"))


def op11_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
