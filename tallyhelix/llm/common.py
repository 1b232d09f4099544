"""Shared helpers: table access, a shared scratch folder, and connected components.

Scratch tables are written below ``spark.checkpoint.dir`` when the session names one (the
shared folder of a cluster), so lineage is cut by data that survives a lost executor.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhelix.session import scratch_dir, ship

#: Space and the control characters 9 to 13 end a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as keep it apart from the columns (Spark ignores case) and the others."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: Rows of a narrow table that one task handles easily.
ROWS = 200_000


class Scratch:
    """Written tables of one operator run; ``drop`` frees those that are no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_dir(spark, name)
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """Writes df and reads it back; with few ``rows`` expected, as few files."""
        at = self.path(name)
        if rows is not None:
            df = df.coalesce(max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS)))
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.scratch_path = at
        return out

    def drop(self, *tables) -> None:
        for t in tables:
            at = t if isinstance(t, str) else getattr(t, "scratch_path", None)
            if at:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def free(self) -> None:
        """Lets Spark clear shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


#: Rows of a narrow table that may be sent to every executor: some 30 MB.
SENT = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """A written narrow table as the side of a join that is sent to every executor if it has at most ``SENT`` rows; else as it is."""
    return F.broadcast(df) if df.count() <= SENT else df


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable, for every id that has an edge.

    Alternating large-star and small-star steps; each step is a min per node and a join back, so
    a hub costs no more than its edges. Ends when all that is left are stars around their least id.
    """
    n = edges.count()
    e = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n)
    while True:
        ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("up")))
        # in a star an id has one edge up, or else only edges from below
        if ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").isEmpty():
            break
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large", 2 * n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = scratch.table(small.where("a <> b").distinct(), "small", 2 * n)
        scratch.drop(e, large)
        e = nxt
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def shared_keys(scratch: Scratch, postings: DataFrame) -> DataFrame:
    """The distinct postings whose key has more than one id, written."""
    many = postings.groupBy("key").agg(F.min("id").alias("i0"), F.max("id").alias("i1")).where("i0 <> i1").select("key")
    many = scratch.table(many, "many")
    scratch.free()
    out = scratch.table(postings.join(many, "key").distinct(), "shared")
    scratch.drop(many)
    scratch.free()
    return out


#: Leader rounds go on while at least one in so many of their pairs links, and end after so many.
FRUITFUL, ROUNDS = 10, 8
#: Keys that a posting lists as those before its own.
BEFORE = 16


def linked(scratch: Scratch, postings: DataFrame, verify, fits: str | Column = "true", alike: str | Column = "true") -> DataFrame:
    """Components (id, comp) of the graph of verified links among ids that share a key.

    postings(key, id, ...), as ``shared_keys`` gives them: two ids are candidates when they share a key and ``fits`` holds, a
    symmetric condition, SQL or a column, on the other columns as ``x.name`` and ``y.name``. ``verify(pairs)`` takes
    (a, b), a < b, and returns those that link. Pairs within one component already found are not
    tested any more, as they cannot change a component: first every id is tested against one
    leader of each of its keys (linear in the postings), again with other leaders as long as that finds many links, and only
    ids of one key that are then still in different components meet each other. No link between components is lost.

    ``alike`` marks postings, by their columns, for which ``fits`` is the same whichever marked key two ids share. A pair meets in the least of
    those keys only: a posting lists marked keys of its id before its own, and of two that have a listed one in common no row is made.
    """
    fits, alike = (F.expr(c) if isinstance(c, str) else c for c in (fits, alike))
    more = [c for c in postings.columns if c not in ("key", "id")]
    side = lambda df, *extra: df.select("key", F.struct("id", *more, "comp", *extra).alias("x"))
    tested, links, p, last = None, None, postings, False
    comps = scratch.spark.range(0).select("id", F.col("id").alias("comp"))
    for r in range(ROUNDS + 1):
        here = p.select("key", "id", *more).join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        rank = F.col("id") if r == 0 else F.xxhash64("id", "key", F.lit(r))  # first few leaders, then one of its own for each key
        lead = here.groupBy("key").agg(F.min(F.struct(rank.alias("o"), F.struct("id", *more, "comp").alias("x"))).alias("l"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        if r:  # keys within one component stay so
            lead = scratch.table(lead, "lead")
            p, old = scratch.table(here.join(lead.select("key"), "key", "left_semi"), "mixed"), p
            here = p
            if old is not postings:
                scratch.drop(old)
        last = last or r == ROUNDS
        if last:
            w = Window.partitionBy("id").orderBy("key").rowsBetween(-BEFORE, -1)
            listed = F.when(alike, F.collect_list(F.when(alike, F.col("key"))).over(w)).otherwise(F.array().cast("array<bigint>"))
            x = scratch.table(side(here.withColumn("before", listed), "before"), "sides")
            y = x.select("key", F.col("x").alias("y"))
            meet = F.expr("x.comp <> y.comp and x.id < y.id") & fits & ~F.arrays_overlap("x.before", "y.before")
        else:
            x, y, meet = side(here), lead.select("key", F.col("l.x").alias("y")), F.expr("x.comp <> y.comp") & fits
        pairs = x.join(y, "key").where(meet).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, "pairs")
        n = pairs.count()
        found = scratch.table(verify(pairs), "links") if n else None
        scratch.free()
        good = found.count() if n else 0
        if n:
            tested = pairs if tested is None else tested.unionByName(pairs)
        if good:
            links = found if links is None else links.unionByName(found)
            comps = scratch.table(components(scratch, links), "comps", 2 * links.count())
        if last:
            break
        last = good * FRUITFUL < n or not n
    return comps
