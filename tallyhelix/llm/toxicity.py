"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

A word is the begin mark, its bytes, and the end mark; every byte and the end is an event, given at most the ``CONTEXT`` symbols before it in the word, so that a
stem carries its evidence whatever endings follow, and so does any later part of a long word. Each class has discounted counts of its own;
what the discount frees goes to one shared distribution, Kneser-Ney over both classes together: discounted counts in the same context, then
continuation counts in ever shorter ones. A rare expression thus says the same in both classes.

Of a toxic document, too, most words are ordinary: its words come with the share ``SHARE`` from the toxic model and else from the ordinary one. The difference of
the two log-likelihoods of a document, per word and per root of words, is turned
into a probability by a logistic curve fitted on parts of the rows that a model of the other parts scored.

Counts and curve come from every labelled row whose crc32(doc_id) mod 3 is not 1: distinct words are counted first, then their events, and the curve is fitted on
the number of rows in each cell of its two features, ``CELLS`` to a unit. Counting, the shared distribution and the ratios are grouped sums and joins; only events
with a ratio other than 1 reach the driver and the workers, which leaves out every context in which no event occurs more than ``DISCOUNT`` times in a class.
Every document is scored over its whole text.

Defined cases: null and empty texts score as a text without evidence (the curve at 0); rows with
null labels are not learned from; of repeated labels of one id the largest holds; where a
class has no row to learn from, the score is 0; equal texts get equal scores; extra columns are not read, and ``keep`` has them kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROWS, Scratch, bounded, fresh, read
from .hashing import letter_bytes, words, words_at
from .words import slices, tidy

#: Symbols of a context: six bytes, so that context and event are one number.
CONTEXT = 6
BEGIN, END = 1, 0
#: The curve is fitted on scores that each of so many parts gets from the model of the others.
FOLDS = 5
#: Cells of a feature to a unit: the features stay within 9 and 17 of 0, so cells are bounded whatever the number of rows.
CELLS = 32
#: Taken off the count of an event in a class, and in both together.
DISCOUNT, SHARED_DISCOUNT = 2.0, 0.75
#: Share of the words of a toxic document that its own model has written.
SHARE = 0.01
#: Evidence of one word is held within this.
MOST = 30.0
LIMIT = 0.7
#: Bytes of text that a worker takes at a time; a longer text is taken alone.
AT_ONCE = 1 << 19


def held_out() -> F.Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def events(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte and the end of the words: (word number, context and event as one number, the event in the lowest byte)."""
    size = end - start + 1
    word = np.repeat(np.arange(len(start)), size)
    rel = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = start[word] + rel
    code = np.where(rel < size[word] - 1, kind[at], END).astype(np.int64)
    for j in range(1, CONTEXT + 1):
        before = np.where(rel >= j, kind[at - j], np.where(rel == j - 1, BEGIN, 0)).astype(np.int64)
        code |= before << (8 * j)
    return word, code


def _encoded(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _distinct_words(raw: list[bytes]):
    """(kind, start, end of one occurrence of each distinct word, which word each occurrence is, its text)."""
    kind, start, end, doc = words_at(raw, letter_bytes())
    h, _ = words(raw, letter_bytes())
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return kind, start[first], end[first], which, doc


def _sample_counts(sample: DataFrame) -> DataFrame:
    """(code, and per part the counts in class 0 and 1) of events in the rows (y, part, text)."""
    cells = [f"c{i}" for i in range(2 * FOLDS)]

    def word_counts(batches):
        tidy()
        for b in batches:
            tag = np.array(b.column("part")) * 2 + np.array(b.column("y"))
            for a, z, texts in slices(b.column("text"), AT_ONCE):
                kind, start, end, which, doc = _distinct_words(_encoded(texts))
                if not len(start):
                    continue
                pair, times = np.unique(which * len(cells) + tag[a:z][doc], return_counts=True)
                size = end - start
                upto = np.concatenate([[0], np.cumsum(size)])
                letters = kind[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])].astype(np.uint8)
                word = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(letters)])
                yield pa.RecordBatch.from_pydict({"word": word.take(pa.array(pair // len(cells))), "tag": pair % len(cells), "n": times})

    def event_counts(batches):
        tidy()
        for b in batches:
            for a, z, texts in slices(b.column("word"), AT_ONCE):
                kind, start, end, _ = words_at(texts, letter_bytes())
                times = np.stack([np.asarray(b.column(c).slice(a, z - a)) for c in cells], 1)
                word, code = events(kind, start, end)
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.diff(code[order], prepend=-1))
                n = np.add.reduceat(times[word[order]], at, 0)
                yield pa.RecordBatch.from_pydict({"code": code[order][at], **{c: n[:, i] for i, c in enumerate(cells)}})

    counted = sample.select("y", "part", "text").mapInArrow(word_counts, "word binary, tag long, n long")
    counted = counted.groupBy("word").agg(*[F.sum(F.when(F.col("tag") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(cells)])
    counted = counted.mapInArrow(event_counts, ", ".join(f"{f} long" for f in ["code", *cells]))
    return counted.groupBy("code").agg(*[F.sum(c).alias(c) for c in cells])


def _low(event: F.Column, n: int) -> F.Column:
    """The lowest ``n`` bytes of an event: itself and what stands before it."""
    return event.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _shared_lower(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(low, lower): ``shared_lower`` of the events by their low bytes, level by level as joins."""
    levels, longer = [], counts.select(F.col("code").alias("low"))
    for m in range(CONTEXT - 1, -1, -1):
        longer = scratch.table(longer.groupBy(_low(F.col("low"), m + 1).alias("low")).agg(F.count("*").alias("n")), f"level{m}")
        levels.append(longer)
    below = None
    for m, level in enumerate(reversed(levels)):
        # a context has at most 256 events
        group = Window.partitionBy(F.shiftright("low", 8))
        level = level.select("low", "n", F.sum("n").over(group).alias("total"), F.count("*").over(group).alias("kinds"))
        base = F.lit(1 / 256)
        if below is not None:
            level = level.withColumn("b", _low(F.col("low"), m)).join(below.select(F.col("low").alias("b"), F.col("lower").alias("base")), "b")
            base = F.col("base")
        below = level.select("low", ((F.col("n") - SHARED_DISCOUNT + SHARED_DISCOUNT * F.col("kinds") * base) / F.col("total")).alias("lower"))
    return below


def _fitted(counts: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted codes, their log-likelihood ratios, those by the model without each part) of the events that tell the classes apart."""
    both = [sum(F.col(f"c{2 * k + y}") for k in range(FOLDS)) for y in (0, 1)]
    ctx = F.shiftright("code", 8).alias("ctx")
    # else nothing is left of the counts in either class, and the ratio is 1
    telling = counts.groupBy(ctx).agg(F.max(F.greatest(*both)).alias("most")).where(F.col("most") > DISCOUNT).select("ctx")
    kept = counts.withColumn("ctx", F.shiftright("code", 8)).join(telling, "ctx", "left_semi")
    kept = scratch.table(kept.withColumn("low", _low(F.col("code"), CONTEXT)).join(_shared_lower(counts, scratch), "low").drop("low"), "kept")
    fields = ["code", "r", *[f"r{k}" for k in range(FOLDS)]]

    def run(batches):
        t = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        col = {c: np.asarray(t.column(c)) for c in t.column_names}
        part = [[col[f"c{2 * k + y}"] for k in range(FOLDS)] for y in (0, 1)]
        o, x = sum(part[0]), sum(part[1])
        r = [ratios(col["code"], col["lower"], o, x), *[ratios(col["code"], col["lower"], o - part[0][k], x - part[1][k]).astype(np.float32) for k in range(FOLDS)]]
        use = np.any([v != 0 for v in r], 0)
        yield pa.RecordBatch.from_arrays([pa.array(v[use]) for v in (col["code"], *r)], names=fields)

    names = ["code", *[f"c{i}" for i in range(2 * FOLDS)], "lower"]
    schema = pa.schema([(c, pa.float64() if c == "lower" else pa.int64()) for c in names])
    # whole contexts in a task, some ROWS events
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), kept.count() // ROWS)
    t = kept.repartition(parts, "ctx").select(*names).mapInArrow(run, "code long, r double, " + ", ".join(f"{f} float" for f in fields[2:])).toArrow()
    order = np.argsort(np.asarray(t.column("code")))
    code, r, *others = (np.asarray(t.column(c))[order] for c in fields)
    return code, r, np.stack(others, 1)


def shared_lower(code: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each distinct event in the next shorter context: how many longer events each continues, level by level."""
    levels, longer = [], code
    for m in range(CONTEXT - 1, -1, -1):
        longer, back, times = np.unique(longer & ((1 << (8 * (m + 1))) - 1), return_inverse=True, return_counts=True)
        levels.append((longer, back, times))
    below = 1 / 256
    for event, back, times in reversed(levels):
        _, group = np.unique(event >> 8, return_inverse=True)
        total, kinds = np.bincount(group, times)[group], np.bincount(group)[group]
        below = ((times - SHARED_DISCOUNT + SHARED_DISCOUNT * kinds * below) / total)[back]
    return below


def ratios(code: np.ndarray, lower: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each event, in the order of the sorted codes, from its counts in both classes; lower as ``shared_lower`` gives it."""
    _, group = np.unique(code >> 8, return_inverse=True)

    def over(count, base, discount):
        total = np.bincount(group, count)[group]
        kept = np.maximum(count - discount, 0)
        left = 1 - np.bincount(group, kept)[group] / np.maximum(total, 1)
        return kept / np.maximum(total, 1) + left * base

    pooled = over(ordinary + toxic, lower, SHARED_DISCOUNT)
    return np.log(over(toxic, pooled, DISCOUNT) / over(ordinary, pooled, DISCOUNT))


def fit(code: np.ndarray, lower: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, their log-likelihood ratios) of the events that tell the classes apart."""
    ratio = ratios(code, lower, ordinary, toxic)
    use = ratio != 0
    return code[use], ratio[use]


def evidence(texts: list, model, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of the toxic mixture over the ordinary one, words) of each text; with ``part`` the ratios have a column for each part, of which a text takes its own."""
    keys, ratio = model
    raw = _encoded(texts)
    kind, start, end, which, doc = _distinct_words(raw)
    if not len(start) or not len(keys):
        return np.zeros(len(texts)), np.bincount(doc, minlength=len(texts)).astype(float)
    word, code = events(kind, start, end)
    at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
    known = np.flatnonzero(keys[at] == code)
    at, word = at[known], word[known]

    def per_word(ratio):
        return np.log1p(SHARE * np.expm1(np.clip(np.bincount(word, ratio[at], len(start)), -MOST, MOST)))

    per = per_word(ratio)[which] if part is None else np.stack([per_word(r) for r in ratio.T])[part[doc], which]
    return np.bincount(doc, per, len(texts)), np.bincount(doc, minlength=len(texts)).astype(float)


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), np.arcsinh(100 * total / n), np.arcsinh(10 * total / np.sqrt(n))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * weight.sum() * b * (np.arange(len(b)) > 0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * weight.sum() * np.diag(np.arange(len(b)) > 0) + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(spark, docs: DataFrame, labels: DataFrame, scratch: Scratch):
    """((keys, ratios), curve), or None where a class has no row to learn from."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~held_out())
    known = scratch.table(known, "known")
    rows = docs.select("doc_id", "text").where(~held_out()).join(bounded(known), "doc_id")
    rows = rows.select("y", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(FOLDS)).cast("int").alias("part"), "text")
    if rows.select("y").distinct().count() < 2:
        return None
    # the lower levels are of all parts: they are the same in both classes
    code, ratio, others = _fitted(scratch.table(_sample_counts(rows), "counts"), scratch)
    scratch.free()

    def run(batches):
        tidy()
        for b in batches:
            for a, z, texts in slices(b.column("text"), AT_ONCE):
                total, n = evidence(texts, (code, others), np.array(b.column("part").slice(a, z - a)))
                cell = np.rint(features(total, n)[:, 1:] * CELLS).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"y": b.column("y").slice(a, z - a), "f": cell[:, 0], "g": cell[:, 1]})

    got = rows.mapInArrow(run, "y int, f long, g long").groupBy("y", "f", "g").agg(F.count("*").alias("n")).orderBy("y", "f", "g").toArrow()
    y, f, g, n = (np.asarray(got.column(c)).astype(float) for c in ("y", "f", "g", "n"))
    curve = logistic(np.stack([np.ones(len(f)), f / CELLS, g / CELLS], 1), y, n / n.mean())
    use = ratio != 0
    return (code[use], ratio[use]), curve


def score(docs: DataFrame, learned, keep: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; or with ``keep`` the rows as they are and the score in a column of that name, which docs must lack."""
    cols = docs.columns if keep else ["doc_id", "text"]
    docs = docs.select(*cols)
    name = keep or "score"
    if learned is None:
        out = docs.withColumn(name, F.lit(0.0))
    else:
        model, curve = learned

        def run(batches):
            tidy()
            for b in batches:
                for a, z, texts in slices(b.column("text"), AT_ONCE):
                    total, n = evidence(texts, model)
                    p = np.round(1 / (1 + np.exp(-np.clip(features(total, n) @ curve, -30, 30))), 9)
                    yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in b.columns], pa.array(p)], names=[*cols, name])

        out = docs.mapInArrow(run, type(docs.schema)([*docs.schema.fields]).add(name, "double"))
    if keep:
        return out
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that score below the limit, columns of any name as they are."""
    [name] = fresh(docs.columns, "score")
    learned = learn(docs.sparkSession, docs, labels, scratch)
    return score(docs, learned, keep=name).where(F.col(name) < LIMIT).drop(name)


def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(spark, docs, read(spark, sf_dir, "labels"), Scratch(spark, "op5")))
