"""Sharding by a Feistel permutation of global row numbers, with native Spark functions only.

Rows are numbered in ascending (doc_id, size, text_crc32) order; a keyed Feistel network over a
grid of a x b cells with cycle walking permutes 0..N-1, and shard and slot are the remainder and
quotient of the permuted number. Shard counts differ by one at most (law ``rows``), the order is
reproducible, and shard and slot can be computed from the row number alone.

Defined cases: a null or empty text has size 1 and crc 0; rows with a null id come first; equal
rows are numbered one after another and can stand for each other; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read

PRIME = 2147483647
#: Keys of the rounds: two for each double round.
KEYS = ((1013904223, 1664525), (22695477, 12820163), (69069, 362437), (521288629, 88675123))
#: Walks past the end of the grid; it has fewer than a spare cells, so a longer walk is next to impossible, and an error.
WALKS = 64


def _mix(x: str, k: str) -> str:
    y = f"(({x} * 48271L + {k}) % {PRIME}L)"
    return f"((({y} % 65536L) * 32749L + ({y} div 65536L) * 69621L + {k}) % {PRIME}L)"


def permuted(row: Column | str, n: int, keys=KEYS) -> Column:
    """The place of a row number among 0..n-1: a bijection for every n.

    Each double round adds a keyed mix of one half to the other, modulo the sides of the grid.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    steps = ", ".join(f"struct({k}L as k, {m}L as m)" for k, m in keys)
    left = f"((s.l + {_mix('s.r', 'q.k')}) % {a}L)"
    body = f"named_struct('l', {left}, 'r', (s.r + {_mix(left, 'q.m')}) % {b}L)"
    once = lambda x: f"aggregate(array({steps}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (s, q) -> {body}, s -> s.l * {b}L + s.r)"
    walk = f"aggregate(sequence(1, {WALKS}), {once('_row')}, (x, i) -> case when x < {n}L then x else {once('x')} end, x -> case when x < {n}L then x else raise_error('a walk left the grid too often') end)"
    return F.expr(f"transform(array({row}), _row -> {walk})[0]")


def numbered(df: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Adds ``row``: 0, 1, ... in the order of the keys, and returns the count.

    The rows are range-partitioned, sorted and written; a row's number is its place in its file
    plus the rows of all files before. Only the count of each file crosses partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = scratch.table(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys), "sorted")
    t = t.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    per = scratch.table(t.groupBy("_file").agg(F.count("*").alias("_n")), "files")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    n = per.agg(F.sum("_n")).first()[0] or 0
    # one row per file of this table, at most spark.sql.shuffle.partitions of them
    return t.join(F.broadcast(starts), "_file").withColumn("row", F.col("_start") + F.col("_at")).drop("_file", "_at", "_start"), n


def shard(docs: DataFrame, scratch: Scratch, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"], scratch)
    rows = rows.withColumn("_p", permuted("row", n))
    return rows.select("doc_id", "size", "text_crc32", "row", (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))


def op8_shard(spark, sf_dir):
    out = shard(read(spark, sf_dir, "documents"), Scratch(spark, "op8"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
