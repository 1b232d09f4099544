"""Genomic-shaped inputs made from the driver's tables, as SQL that reads the same in Spark and in the oracle's engine.

24 samples x 60 windows on chr1, chr2, chrX and chrY with planted copy-number events, alignments with split
reads, raw overlapping exons, a fixed set of clusters, calls and breakpoints. Each entry may use those before.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhelix.session import ship


TABLES = {
    "samples": "select distinct cast(c_custkey % 24 as int) s from customer",
    "numbers": "select distinct cast(p_partkey % 60 as int) w from part",
    "windows": """select cast(w as bigint) widx, case when w < 20 then 'chr1' when w < 40 then 'chr2' when w < 50 then 'chrX' else 'chrY' end chrom,
      cast((w - case when w < 20 then 0 when w < 40 then 20 when w < 50 then 40 else 50 end) * 1000 as bigint) st,
      cast((w - case when w < 20 then 0 when w < 40 then 20 when w < 50 then 40 else 50 end) * 1000 + 200 as bigint) en,
      case when w % 6 = 5 then concat('intergenic_', cast(cast(floor(w / 6) as int) as string)) else concat('E_', cast(w as string)) end id,
      case when w % 6 = 5 then 2 when w >= 40 then 1 else 0 end wtype from numbers""",
    "counts": """select cast(s as int) s, cast(w as bigint) widx, cast(sum(wt) as bigint) n from (
      select s, w, case when w % 6 = 5 then case when k % 25 = 0 then 1 else 0 end
        when w >= 50 then case when s % 2 = 1 then k % 2 else 0 end
        when w >= 40 then case when s % 2 = 1 then k % 2 else 1 end
        when s = 3 and w between 24 and 28 then case when k % 40 = 0 then 1 else 0 end
        when s = 7 and w between 30 and 34 then k % 2
        when s = 11 and w between 12 and 16 then 2 else 1 end wt
      from (select l_orderkey % 24 s, l_partkey % 60 w, cast(floor(l_orderkey / 24) as bigint) + l_linenumber k from lineitem) r) x group by s, w""",
    "cells": """select samples.s, windows.widx, chrom, st, en, id, wtype, coalesce(counts.n, 0) n from samples cross join windows
      left join counts on counts.s = samples.s and counts.widx = windows.widx""",
    "alignments": """select concat('S', lpad(cast(q % 24 as string), 2, '0')) sample, cast(q as string) qname,
      cast(case when rn % 2 = 1 then 99 else 147 end + case when rn > 2 then 2048 else 0 end + case when q % 97 = 0 then 1024 else 0 end - case when q % 89 = 0 and rn = 3 then 16 else 0 end as int) flag,
      case when p % 50 = 0 then 'chrUn_1' when rn = 2 and q % 61 = 0 then 'chr2' else concat('chr', cast(q % 2 + 1 as string)) end chrom,
      cast(case when rn = 1 then base when rn = 2 then base + 120 + case when q % 13 = 0 then 2500 else 0 end
        when rn = 3 then case when u % 2 = 0 then base - 600 else base + 900 end else base + 780 end as bigint) pos,
      cast(case when p % 37 = 0 then 10 else 60 end as int) mapq,
      case when rn > 2 then concat(cast(60 as string), 'S', cast(40 + qt % 20 as string), 'M') else concat(cast(80 + qt % 20 as string), 'M', case when q % 5 = 0 then '2I10D8M' else '20S' end) end cigar,
      cast(rn as bigint) ord from (
        select *, q % 8 k, (q * 7919) % 18000 + 601 base from (
          select l_orderkey q, l_partkey p, l_suppkey u, cast(l_quantity as int) qt, l_linenumber ln,
            row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn from lineitem) b) f""",
    "exons": """select chrom, st, en, concat('X', chrom, '_', cast(st as string), '_', cast(en as string)) id from (
      select distinct case l_partkey % 5 when 0 then 'chr1' when 1 then 'chr2' when 2 then 'chr11' when 3 then 'chrX' else 'chrY' end chrom,
        cast(l_orderkey * 30 + l_partkey % 200 as bigint) st, cast(l_orderkey * 30 + l_partkey % 200 + cast(l_quantity as int) as bigint) en
      from lineitem) e""",
    "members": """select case when s % 4 < 2 then 'A_01' when s % 4 = 2 then 'A_02' else 'A_03' end cluster_id, s from samples
      union all select case when s % 2 = 0 then 'G_01' else 'G_02' end, s from samples""",
    "clusters": """select distinct cluster_id, case cluster_id when 'A_02' then 'A_01' when 'A_03' then 'A_01,A_02' else '' end fit_with,
      case cluster_id when 'G_01' then 'F' when 'G_02' then 'M' else '' end gender, case cluster_id when 'A_03' then 0 else 1 end valid from members""",
    "calls": """select s, cn, cast((s * 7 + cn * 11) % 17 + 20 * ((s + cn) % 2) as bigint) first_w, cast((s * 7 + cn * 11) % 17 + 20 * ((s + cn) % 2) + (s + cn) % 3 as bigint) last_w, qs from (
      select cast(l_orderkey % 24 as int) s, cast(case l_linenumber % 3 when 0 then 0 when 1 then 1 else 3 end as int) cn, cast(sum(l_partkey) % 997 as double) / 100 + 0.0001 qs
      from lineitem group by 1, 2) c""",
    "bps": """select s, 'chr1' chrom, cast(k * 1000 - 300 as bigint) bp_start, cast((k + (s + k) % 3) * 1000 + 500 as bigint) bp_end, case when (s + k) % 2 = 0 then 'DEL' else 'DUP' end cnvtype, cast(1 + (s + k) % 4 as bigint) n_qnames
      from samples cross join (select w k from numbers where w > 0 and w < 20) n""",
    "metadata": """select concat('S', cast(c_custkey as string)) sample_id, case when c_nationkey % 3 = 0 then 'F' when c_nationkey % 3 = 1 then 'M' else '' end sex,
      case when c_custkey % 11 = 0 then 'suspected XX' when c_custkey % 13 = 0 then 'suspected XXY' when c_custkey % 17 = 0 then 'suspected XXY or contamination' when c_custkey % 19 = 0 then 'suspected contamination' else '' end qc,
      case r_name when 'ASIA' then 'Novogene' when 'EUROPE' then 'Genoscope_2' else r_name end center, n_name capture, c_mktsegment batch_date
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
}


def closure(text: str, tables: dict[str, str]) -> str:
    """The entries that a text names, with what they need, in order, as a list of common table expressions."""
    need: set[str] = set()

    def visit(t: str) -> None:
        for name in set(re.findall(r"\b[a-z_0-9]+\b", t)) & tables.keys() - need:
            need.add(name)
            visit(tables[name])

    visit(text)
    return ",\n".join(f"{k} as ({v})" for k, v in tables.items() if k in need)


class Fixture:
    """The inputs as DataFrames, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def sql(self, body: str) -> DataFrame:
        ctes = closure(body, TABLES)
        text = f"with {ctes} {body}" if ctes else body
        for t in ("lineitem", "customer", "nation", "region", "orders", "part", "supplier"):
            text = re.sub(rf"\b(from|join) {t}\b", rf"\1 parquet.`{self.sf_dir}/{t}.parquet`", text)
        return self.spark.sql(text)

    def table(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def fpm(self) -> DataFrame:
        from tallyhelix.operators.models import fpm

        return fpm(self.cells).persist()

    @cached_property
    def autosomes(self) -> DataFrame:
        return self.fpm.where("wtype = 0")

    @cached_property
    def grown(self):
        from tallyhelix.operators.cluster import grown

        return grown(self.autosomes)

    @cached_property
    def models(self) -> DataFrame:
        from tallyhelix.operators.models import cn0, ecodes, fitted

        return ecodes(fitted(self.autosomes), cn0(self.fpm)).persist()  # a row per window

    @cached_property
    def lik(self) -> DataFrame:
        from tallyhelix.operators.models import likelihoods

        return likelihoods(self.autosomes, self.models).persist()

    @cached_property
    def priors(self) -> list[float]:
        from tallyhelix.operators.hmm import priors

        return priors(self.lik)[0]

    @cached_property
    def called(self) -> DataFrame:
        return self.windows.join(self.models.where("ecode >= 0").select("widx"), "widx", "left_semi")

    @cached_property
    def cutoffs(self):
        from tallyhelix.operators.windows import gap_cutoffs

        return gap_cutoffs(self.called).first()  # one row

    @cached_property
    def pool(self) -> DataFrame:
        from tallyhelix.operators.calling import pool

        return pool(self.fpm, self.clusters, self.members)

    @cached_property
    def pooled_models(self) -> DataFrame:
        from tallyhelix.operators.calling import models

        return models(self.pool)

    @cached_property
    def names(self) -> dict[int, str]:
        """Number and name of each sample."""
        return {r["s"]: f"S{r['s']:02d}" for r in self.samples.orderBy("s").collect()}

    @cached_property
    def frags(self) -> DataFrame:
        from tallyhelix.operators.fragments import fragments

        return fragments(self.alignments, self.windows)

    def lines(self, df: DataFrame, *columns: str, sep: str = "\t") -> DataFrame:
        """Rows as text lines, to feed the parsers."""
        return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("value"))
