"""URL filter: rules by host and path, then link-graph propagation over hosts; native Spark only.

Trust flows along links from the hosts of allowed pages (personalised PageRank), distrust flows
against links from the hosts of blocked pages: who links to a blocked host is suspect. A page
that no rule fits takes its host's verdict: block when distrust exceeds trust and a multiple of
the mean score of hosts.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, verdict allow;
null html has no links; hosts seen only in links take part in the graph; repeated rows count as
they occur; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, read

#: (host, start of the path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rounds of the SQL version, after which less than a 30,000th of a score is still to come; the operator itself goes on until scores settle.
ROUNDS = 64
#: Decimals of scores beyond those of one over the number of hosts, so that the grid gets finer as scores get smaller.
FINE = 12
DAMPING = 0.85
#: Scores have settled when a round moves less than this part of the blocking level, all hosts together.
SETTLED = 1e-3
#: Rounds between two looks at the change, and written tables.
STRIDE = 4
#: A host is blocked from this multiple of the mean score upwards.
MULTIPLE = 0.5
LINK = r"""(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def propagate(scratch: Scratch, hosts: DataFrame, edges: DataFrame, seed: str, level: float, places: int = FINE) -> DataFrame:
    """(host, score): personalised PageRank over weighted edges (src, dst, n) from seeds in column ``seed``.

    Hosts without links out keep nothing to pass on; scores are rounded to ``places`` decimals so that order of addition cannot show.
    Scores begin at the seeds' own part and only grow, on a grid and below 1, so rounds end. What is
    then still to come is at most DAMPING / (1 - DAMPING) of the last change, far below ``level``.
    """
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = scratch.table(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "shares")
    base = hosts.select("host", F.col(seed).alias("s"))
    rank = base.select("host", F.round((1 - DAMPING) * F.col("s"), places).alias("score"))
    kept = None
    while True:
        for _ in range(STRIDE):
            flow = rank.join(share, rank["host"] == share["src"]).groupBy("dst").agg(F.sum(F.round(F.col("score") * F.col("w"), places).cast(f"decimal(38,{places})")).cast("double").alias("got"))
            before = rank.select("host", F.col("score").alias("was"))
            rank = base.join(flow, F.col("host") == F.col("dst"), "left").select("host", F.round((1 - DAMPING) * F.col("s") + DAMPING * F.coalesce("got", F.lit(0.0)), places).alias("score"))
        rank = scratch.table(rank.join(before, "host"), "rank")
        moved = rank.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        scratch.drop(kept)
        kept, rank = rank, rank.select("host", "score")
        if moved <= SETTLED * level:
            return rank


def judge(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)).alias("links"))
    p = p.withColumn("fit", rule_of(F.col("host"), F.col("path")))
    p = scratch.table(p.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("fixed"), "links"), "pages")
    edges = p.where("host <> ''").groupBy("host", "links").agg(F.count("*").alias("c")).select(F.col("host").alias("src"), F.explode("links").alias("dst"), "c")
    edges = edges.withColumn("dst", ascii_lower(F.col("dst"))).where("src <> dst").groupBy("src", "dst").agg(F.sum("c").alias("n"))
    edges = scratch.table(edges, "edges")
    own = p.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("fixed") == "allow", 1)).alias("good"), F.count(F.when(F.col("fixed") == "block", 1)).alias("bad"))
    met = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = own.join(met, "host", "full_outer").select("host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    hosts = scratch.table(hosts, "hosts")
    sums = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count("*").alias("n")).first()
    hosts = hosts.select("host", (F.col("good") / F.lit(float(sums["g"] or 1))).alias("good"), (F.col("bad") / F.lit(float(sums["b"] or 1))).alias("bad"))
    level, places = MULTIPLE / max(sums["n"], 1), FINE + len(str(sums["n"]))
    trust = propagate(scratch, hosts, edges, "good", level, places).withColumnRenamed("score", "trust")
    distrust = propagate(scratch, hosts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), "bad", level, places).withColumnRenamed("score", "distrust")
    scores = trust.join(distrust, "host").withColumn("by_host", F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= level), "block").otherwise("allow"))
    scores = scratch.table(scores, "scores")
    out = p.drop("links").join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", "by_host", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op4_urls(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages"), Scratch(spark, "op4")).select("page_id", "host", "path", "rule", "verdict")


def op4_sql() -> str:
    """The same scores, with one common table expression per round."""

    def rounds(tag: str, seed: str, src: str, dst: str) -> str:
        out = [f"{tag}s as materialized (select e.{src} src, e.{dst} dst, e.n::double / t.total w from edges e join (select {src}, sum(n)::double total from edges group by 1) t using ({src}))", f"{tag}0 as (select host, {seed} score from hosts)"]
        for i in range(1, ROUNDS + 1):
            out.append(f"{tag}{i} as materialized (select h.host, round({1 - DAMPING!r} * h.{seed} + {DAMPING!r} * coalesce(f.got, 0), 12) score from hosts h left join (select s.dst, sum(round(r.score * s.w, 12)::decimal(38,12))::double got from {tag}{i - 1} r join {tag}s s on r.host = s.src group by 1) f on h.host = f.dst)")
        return ",\n".join(out)

    fits = " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then {{{i}}}" for i, (h, p, _) in sorted(enumerate(RULES), key=lambda x: -len(x[1][0] + x[1][1])))
    rule = fits.format(*[f"'{h}{p}'" for h, p, _ in RULES])
    fixed = fits.format(*[f"'{v}'" for *_, v in RULES])
    link = LINK.replace("'", "''")
    return f"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path, regexp_extract_all(coalesce(html, ''), '{link}', 1) links from pages),
p as (select page_id, host, path, links, case {rule} else null end as rule, case {fixed} else null end as fixed from u),
l as (select host src, translate(unnest(links), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') dst from p where host <> ''),
edges as (select src, dst, count(*) n from l where src <> dst group by 1, 2),
own as (select host, count(*) filter (fixed = 'allow') good, count(*) filter (fixed = 'block') bad from p where host <> '' group by 1),
met as (select src host from edges union select dst from edges),
h0 as (select host, coalesce(good, 0) good, coalesce(bad, 0) bad from own full join met using (host)),
hosts as (select host, good::double / greatest(sum(good) over (), 1) good, bad::double / greatest(sum(bad) over (), 1) bad from h0),
{rounds('t', 'good', 'src', 'dst')},
{rounds('d', 'bad', 'dst', 'src')},
v as (select t.host, case when d.score > t.score and d.score >= {MULTIPLE!r} / (select count(*) from hosts) then 'block' else 'allow' end by_host from t{ROUNDS} t join d{ROUNDS} d using (host))
select p.page_id, p.host, p.path, p.rule, coalesce(p.fixed, v.by_host, 'allow') as verdict from p left join v on p.host = v.host
"""
