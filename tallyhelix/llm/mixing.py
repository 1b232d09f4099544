"""Mixing sources to target weights, with native Spark functions only.

Tokens are summed per source, each source gets a target by weight with a repetition limit, and a
document is emitted floor(rate) times plus one more copy with probability rate - floor(rate),
decided by a hash of its id and a seed, so that reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
with a null id draw by their text; repeated rows share the draw of their id; an empty table gives an
empty result; other columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, fresh, read

#: Sources in code point order weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often.
MAX_RATE = 3


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), one row per source.

    The level l solves sum(min(3 size, l weight)) = sum(size). With sources in the order of
    3 size / weight, the level is the largest of (total - capped before) / weight from here on.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * MAX_RATE).withColumn("ratio", F.col("most") / F.col("weight"))
    w = w.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
    w = w.withColumn("level", F.max("level").over(every))
    return w.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def draw(doc_id, body, seed: int):
    """A number in [0, 1) from the id and the seed: 52 bits of MD5. Rows without an id draw by their text."""
    text = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.coalesce(F.md5(body.cast("binary")), F.lit("")))))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def mix_plan(docs: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often each row is taken."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u"))
    sized = scratch.table(sized, "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(per)
    t = t.select(F.col("source").alias("_source"), "source_size", "target")
    out = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return out.withColumn("copies", whole + F.when(F.col("u") < rate - whole, 1).otherwise(0)).drop("u")


def mix(docs: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """The documents, each as many times as the mix takes it; columns as given, of any name."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    per = scratch.table(docs.select("source", size.alias("n")).groupBy("source").agg(F.sum("n").alias("source_size")), "sources")
    of, rate, copy = fresh(docs.columns, "of", "rate", "copy")
    t = targets(per).select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    whole = F.floor(rate)
    copies = (whole + F.when(draw(F.col("doc_id"), F.col("text"), seed) < F.col(rate) - whole, 1).otherwise(0)).cast("int")
    out = docs.join(t, F.col("source").eqNullSafe(F.col(of)))
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op7_mix(spark, sf_dir):
    s = Scratch(spark, "op7")
    plan = mix_plan(read(spark, sf_dir, "documents"), s)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight from s),
r as (select *, source_size * 3 most, (source_size * 3)::double / weight ratio from w),
l as (select *, (sum(source_size) over () - coalesce(sum(most) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
  / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following)::double lev from r),
t as (select source, source_size, least(most::double, max(lev) over () * weight) target from l),
j as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end rate,
  ('0x' || substr(md5('mix:0:' || coalesce(cast(d.doc_id as varchar), 'null' || coalesce(md5(d.text), ''))), 1, 13))::bigint / 4503599627370496.0::double u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) * size as taken from j
"""
