"""Every operator as a named query over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhelix.functions import scalar as fn
from tallyhelix.operators import calling
from tallyhelix.operators import calls as ca
from tallyhelix.operators import cluster as cl
from tallyhelix.operators import fragments as fr
from tallyhelix.operators import hmm, merging, qc, reuse
from tallyhelix.operators import models as mo
from tallyhelix.operators import windows as wi
from tallyhelix.operators.numbering import numbered
from tallyhelix.plans import run
from tallyhelix.plans.fixture import Fixture
from tallyhelix.plans.oracle import ARGMAX, sql
from tallyhelix.session import scratch_dir, written
from tallyhelix.sources import bam, sinks, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAD, MIN_SAMPLES = 10, 10


def query(body: str | None = None):
    """Registers a function of the inputs under its name; ``body`` is the oracle's query."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if body is not None:
            SQL[f.__name__] = sql(body)
        return f

    return add


def r(column: str, digits: int = 3):
    return F.round(F.col(column), digits).alias(column)


# --- sources


@query("select concat('/data/', sample, case when k % 2 = 0 then '.bam' else '.sam' end) path, sample from (select distinct sample, substr(sample, 2)::int k from alignments)")
def src_samples(x: Fixture):
    s = x.alignments.select("sample").distinct()
    return text.sample_paths(s.select(F.concat(F.lit("/data/"), "sample", F.when(F.substring("sample", 2, 2).cast("int") % 2 == 0, ".bam").otherwise(".sam")).alias("path")))


@query("select sample, qname, flag, chrom, pos, mapq, cigar, ord from alignments")
def src_align(x):
    """Samples of even number from binary files, read in ranges of bytes, the others from lines of text; ``ord`` counts the alignments of a name."""
    even = F.substring("sample", 2, 2).cast("int") % 2 == 0
    at, samples = _folder(x, "bams"), [n for s, n in x.names.items() if s % 2 == 0]
    chroms = [r["chrom"] for r in x.alignments.select("chrom").distinct().orderBy("chrom").collect()]  # names of chromosomes
    bam.write_bam(x.alignments.where(even), at, [(c, 1 << 28) for c in chroms])
    head = x.spark.createDataFrame([("@HD\tVN:1.6", "S01", -2), ("@SQ\tSN:chr1\tLN:20000", "S01", -1)], "value string, sample string, ord long")
    binary = bam.read_bam(x.spark, [f"{at}/{n}.bam" for n in samples], split_bytes=1 << 22)
    read = binary.unionByName(text.sam(head.unionByName(_sam_lines(x).where(~even))))
    by = Window.partitionBy("sample", "qname").orderBy("ord")  # a few rows each
    return read.withColumn("ord", F.row_number().over(by).cast("long"))


def _sam_lines(x):
    return x.alignments.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("qname", "flag", "chrom", "pos", "mapq", "cigar")]).alias("value"), "sample", "ord")


@query(f"select chrom, greatest(st - {PAD}, 0) st, en + {PAD} en, id from exons")
def src_bed(x):
    return text.bed(x.lines(x.exons, "chrom", "st", "en", "id"), PAD)


@query("select s, widx, n from cells")
def src_counts(x):
    at = _folder(x, "counts")
    sinks.write_counts(x.cells.select("s", "widx", "n"), at)
    return text.read_counts(x.spark, at)


@query("select c.cluster_id, fit_with, gender, valid, string_agg(concat('S', lpad(s::string, 2, '0')), ',' order by s) samples from clusters c join members m using (cluster_id) group by 1, 2, 3, 4")
def src_clust(x):
    t = text.cluster_table(sinks.cluster_lines(x.clusters, _members(x)))
    return t.select("cluster_id", F.array_join("fit_with", ",").alias("fit_with"), "gender", "valid", F.array_join("samples", ",").alias("samples"))


def _members(x):
    return x.members.select("cluster_id", "s", F.format_string("S%02d", "s").alias("sample"))


@query("select concat('S', lpad(s::string, 2, '0')) sample, chrom, bp_start, bp_end, cnvtype, n_qnames from bps where n_qnames >= 2")
def src_bp(x):
    b = x.bps.withColumn("sample", F.format_string("S%02d", "s")).withColumn("qnames", F.lit("q"))
    return text.breakpoint_table(sinks.breakpoint_lines(b))


def _geno(x):
    c = ca.frag_ratios(x.calls, x.fpm, x.models)
    return ca.genotypes(ca.with_breakpoints(ca.break_ranges(c, x.windows, x.models, PAD), x.bps))


def _vcf_lines(x):
    return ca.variant_lines(ca.variant_rows(_geno(x), x.names))


@query("select k.chrom, k.pos, k.end_pos, k.alt, concat('S', lpad(samples.s::string, 2, '0')) sample, coalesce(g.text, '0/0') as text from (select distinct chrom, pos, end_pos, alt from geno_text) k cross join samples left join geno_text g on g.chrom = k.chrom and g.pos = k.pos and g.end_pos = k.end_pos and g.alt = k.alt and g.s = samples.s")
def src_vcf(x):
    return text.vcf_genotypes(_vcf_lines(x), list(x.names.values()))


@query("select concat('S', lpad(s::string, 2, '0')) sample, 'chr1' chrom, s * 700::bigint st, s * 700 + 2500::bigint en from samples")
def src_regions(x):
    item = F.format_string("S%02d:chr1:%d-%d", "s", F.col("s") * 700, F.col("s") * 700 + 2500)
    return text.regions(x.samples.groupBy((F.col("s") % 4).alias("g")).agg(F.array_join(F.collect_list(item), ",").alias("value")).select("value"))


BATCH_SQL = "case when starts_with(center, 'Genoscope') or starts_with(center, 'Novogene') then concat_ws('_', center, capture, batch_date) else concat_ws('_', center, capture) end"
SEX_SQL = "case when qc = 'suspected XX' then 'F' when qc in ('suspected XXY', 'suspected XXY or contamination') then 'XXY' when qc in ('', 'suspected contamination') then sex else error('unknown note') end"


def _meta(x):
    head = "Center\tsampleID\tSex\tQuality control\tcapture\tDate"
    lines = x.spark.createDataFrame([(head,)], "value string").unionByName(x.lines(x.metadata, "center", "sample_id", "sex", "qc", "capture", "batch_date"))
    return text.metadata(lines, head)


@query(f"select sample_id sample, {SEX_SQL} sex, {BATCH_SQL} batch from metadata")
def src_meta(x):
    return _meta(x)


@query("select concat('S', lpad((s)::string, 2, '0')) sample, concat('E_', s) id from samples")
def src_tocheck(x):
    return text.to_check(x.samples.select(F.concat_ws("\t", F.format_string("S%02d", "s"), F.concat(F.lit("E_"), F.col("s").cast("string"))).alias("value")))


# --- sinks


def _folder(x, name):
    return scratch_dir(x.spark, name)


@query("select s, widx, n from cells")
def snk_counts(x):
    at = _folder(x, "counts")
    sinks.write_counts(x.cells.select("s", "widx", "n"), at)
    return text.read_counts(x.spark, at)


@query("select sample, chrom, bp_start, bp_end, cnvtype, n_qnames from found_bps")
def snk_bp(x):
    at = _folder(x, "breakpoints")
    sinks.write_breakpoints(fr.breakpoints(x.frags), at)
    return text.read_breakpoints(x.spark, at, list(x.names.values()), 1)


@query("select cluster_id, concat_ws(chr(9), cluster_id, fit_with, gender, valid, string_agg(concat('S', lpad(s::string, 2, '0')), ',' order by s)) as value from clusters join members using (cluster_id) group by cluster_id, fit_with, gender, valid")
def snk_clust(x):
    at = _folder(x, "clusters")
    sinks.write_clusters(x.clusters, _members(x), at)
    lines = text.read_lines(x.spark, at)
    text.cluster_table(lines).count()  # what was written can be read
    return lines.where(F.col("value") != sinks.CLUSTER_HEADER).select(F.split("value", "\t")[0].alias("cluster_id"), "value")


@query("select chrom, pos, end_pos, alt, s, gt, gq, fr, bpr, coalesce(bp, '') bp from geno")
def snk_vcf(x):
    return _geno(x).withColumn("bp", F.coalesce("bp", F.lit("")))


#: The header that the oracle expects.
VCF_HEAD = sinks.vcf_header([f"S{s:02d}" for s in range(24)], 5.0, "260101", "call")


def _head(x):
    return sinks.vcf_header(list(x.names.values()), 5.0, "260101", "call")


VCF_ROWS_SQL = """select concat_ws(chr(9), k.chrom, k.pos, '.', 'N', k.alt, '.', 'PASS', concat('SVTYPE=', k.alt[2:4], ';END=', k.end_pos), k.form, string_agg(coalesce(g.text, '0/0'), chr(9) order by samples.s)) as value
  from (select chrom, pos, end_pos, alt, case when bool_or(bp is not null) then 'GT:GQ:FR:BPR:BP' else 'GT:GQ:FR:BPR' end form from geno group by 1, 2, 3, 4) k cross join samples
  left join geno_text g on g.chrom = k.chrom and g.pos = k.pos and g.end_pos = k.end_pos and g.alt = k.alt and g.s = samples.s group by k.chrom, k.pos, k.end_pos, k.alt, k.form"""


@query(f"{VCF_ROWS_SQL} union all select replace(unnest([{', '.join(repr(h.replace(chr(9), '@')) for h in VCF_HEAD)}]), '@', chr(9))")
def snk_vcf_text(x):
    """The written file, header and rows, read back."""
    at = _folder(x, "vcf")
    sinks.write_lines(_vcf_lines(x), at, _head(x), list(ca.ROW_ORDER))
    return text.read_lines(x.spark, at)


@query("select '5.0' min_gq, (row_number() over (order by s) - 1)::int i, concat('S', lpad(s::string, 2, '0')) sample from samples")
def src_vcf_header(x):
    """The least score and the samples, from the header of a written file."""
    at = _folder(x, "vcf")
    sinks.write_lines(_vcf_lines(x), at, _head(x), list(ca.ROW_ORDER))
    lines = text.read_lines(x.spark, at)
    return text.vcf_samples(lines).crossJoin(F.broadcast(text.vcf_min_gq(lines)))  # one row


def _digest(b: str) -> str:
    """A whole SHA-256 modulo 1000, in SQL: 8 hex digits at a time."""
    out = "0"
    for i in range(8):
        out = f"(({out} * {16**8 % 1000} + ('0x' || substr(sha256({b}), {1 + 8 * i}, 8))::bigint) % 1000)"
    return out


MERGE_SQL = """select k.chrom, k.pos, k.end_pos, k.alt, k.ckey, k.form, samples.s, coalesce(g.text, '0/0') as text from (
  select chrom, pos, end_pos, alt, case when regexp_matches(b, '^[0-9]+$') then try_cast(b as bigint) when b = 'X' then 1023 when b = 'Y' then 1024 when b in ('M', 'MT') then 1025
    else 1100 + {digest} end ckey, case when bool_or(regexp_matches(text, '(:.*){{4}}')) then 'GT:GQ:FR:BPR:BP' else 'GT:GQ:FR:BPR' end form from (select *, regexp_replace(chrom, '^chr', '') b from geno_text) group by chrom, pos, end_pos, alt, b) k
  cross join samples left join geno_text g on g.chrom = k.chrom and g.pos = k.pos and g.end_pos = k.end_pos and g.alt = k.alt and g.s = samples.s""".format(digest=_digest("b"))


def _cluster_files(x) -> list[str]:
    """Written variant files of four groups of samples."""
    g, at = written(_geno(x), "geno"), _folder(x, "vcfs")
    for i in range(4):
        own = {s: n for s, n in x.names.items() if s % 4 == i}
        lines = ca.variant_lines(ca.variant_rows(g.where(F.col("s") % 4 == i), own))
        sinks.write_lines(lines, f"{at}/{i}", sinks.vcf_header(list(own.values()), 5.0, "260101", "call"), list(ca.ROW_ORDER))
    return [f"{at}/{i}" for i in range(4)]


MERGED_LINES_SQL = f"""select (row_number() over (order by ckey, pos, end_pos, alt, chrom))::bigint place, concat_ws(chr(9), chrom, pos, '.', 'N', alt, '.', 'PASS', concat('SVTYPE=', alt[2:4], ';END=', end_pos), form, texts) as value
  from (select chrom, pos, end_pos, alt, ckey, form, string_agg(text, chr(9) order by s) texts from ({MERGE_SQL}) group by 1, 2, 3, 4, 5, 6)"""


@query(MERGED_LINES_SQL)
def snk_merged(x):
    """The rows of the merged file of four clusters' files, in their order in it."""
    at = _folder(x, "merged")
    merging.merge_files(x.spark, _cluster_files(x), list(x.names.values()), at)
    lines = written(text.read_in_order(x.spark, at), "lines")
    return numbered(lines.where(~F.col("value").startswith("#")), ["file", "at"]).select("place", "value")


@query("select ecode, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 6) pct from models group by ecode")
def snk_log(x):
    n = x.models.groupBy("ecode").agg(F.count("*").alias("n"))
    return n.select("ecode", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


@query()
def snk_dendro(x):
    """Nodes of the tree with the cluster all their samples share, or a mark for virtual nodes."""
    return cl.dendrogram(x.grown, "A", MIN_SAMPLES)


@query("""select widx, bins, bin, n from (select widx, bins, least(floor((fpm - lo) / ((hi - lo) / bins))::bigint, bins - 1) + 1 bin, count(*) n
  from autos join (select widx, min(fpm) lo, max(fpm) hi, greatest(20, ceil(count(*) / 4.0))::bigint bins from autos group by widx) using (widx) where hi > lo group by all)""")
def snk_exonplot(x):
    return qc.histogram(x.autosomes)


@query("""select widx, i::int i, round(x, 3) x, round(2e6 / (sd0 * sqrt(2 * pi())) * exp(-(x * x) / (2 * sd0 * sd0)), 3) p0, round(1e6 * exp(-0.5 * ((x - mu / 2) / (sd / 2)) ** 2) / (sd / 2 * sqrt(2 * pi())), 3) p1,
  round(1e6 * exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * sqrt(2 * pi())), 3) p2,
  round(case when x > mu + 2 * sd then 1e6 * exp(-0.5 * ((ln(x - mu - 2 * sd) - ln(mu)) / 0.5) ** 2) / ((x - mu - 2 * sd) * 0.5 * sqrt(2 * pi())) else 0.0 end, 3) p3
  from (select widx, i, ceil(top) * i / 999.0::double x, mu, sd, sd0 from (select widx, max(fpm) top from autos group by widx) join models using (widx) cross join (select unnest(range(1000)) i) where ecode not in (-1, -2))""")
def snk_exonplot_curves(x):
    c = qc.state_curves(x.autosomes, x.models)
    return c.select("widx", "i", r("x"), *[F.round(F.col(f"p{k}") * 1e6, 3).alias(f"p{k}") for k in range(4)])


@query(f"select {BATCH_SQL} batch, count(*) n from metadata group by 1")
def snk_dev(x):
    return _meta(x).groupBy("batch").agg(F.count("*").alias("n"))


@query("select ecode, n, round(100.0::double * n / sum(n) over (), 2) pct from (select ecode, count(*) n from models where ecode <> -1 group by ecode)")
def snk_dev_pie(x):
    return qc.code_shares(x.models)


@query("""select cn, round(m / sum(m) over (), 6) frequency, round(sd / sum(m) over (), 6) sd from (select cn, avg(n) m, stddev_pop(n) sd from (
  select a.s, c.cn, count(b.state) n from (select distinct s from states) a cross join (select unnest(range(4))::int cn) c left join states b on b.s = a.s and b.state = c.cn group by 1, 2) group by cn)""")
def snk_dev_bar(x):
    return qc.state_frequencies(_states(x)).select("cn", r("frequency", 6), r("sd", 6))


# --- filters and projections

PLAIN = "sample, qname, flag, chrom, pos, mapq, cigar, ord"


@query(f"select {PLAIN} from usable")
def flt_align(x):
    return fr.usable(x.alignments)


@query(f"select {PLAIN} from known")
def flt_chrom(x):
    return fr.on_known_chroms(fr.usable(x.alignments), x.windows).select(*PLAIN.split(", "))


def _qn(x):
    return fr.qnames(fr.on_known_chroms(fr.usable(x.alignments), x.windows))


@query("select sample, qname, chrom from qn where chroms = 1")
def flt_qn_chrom(x):
    return fr.one_chrom(_qn(x)).select("sample", "qname", "chrom")


@query("select sample, qname, chrom from qn where chroms = 1 and orients = 1")
def flt_qn_strand(x):
    return fr.one_orientation(fr.one_chrom(_qn(x))).select("sample", "qname", "chrom")


def _fit(x):
    return fr.fit_strands(fr.one_orientation(fr.one_chrom(_qn(x))))


@query("select sample, qname, len(f0)::int nf, len(r0)::int nr from fitq")
def flt_qn_card(x):
    return _fit(x).select("sample", "qname", F.size("f").alias("nf"), F.size("r").alias("nr"))


@query("select sample, qname, coalesce(len(f0), 0)::int nf, coalesce(len(r0), 0)::int nr from qn")
def prj_strand(x):
    return _qn(x).select("sample", "qname", F.size("f").alias("nf"), F.size("r").alias("nr"))


def _text_of(c: str):
    return F.array_join(F.transform(c, lambda a: F.format_string("%d-%d", a["s"], a["e"])), ";").alias(c)


@query("select sample, qname, list_aggregate(list_transform(f, lambda a: concat(a.s, '-', a.e)), 'string_agg', ';') f, list_aggregate(list_transform(r, lambda a: concat(a.s, '-', a.e)), 'string_agg', ';') r from ordered")
def prj_readord(x):
    return _fit(x).select("sample", "qname", _text_of("f"), _text_of("r"))


@query("select sample, qname, nf::int nf, f1s fs, f1e fe, nr::int nr, r1s rs, r1e re from strands")
def prj_merge2(x):
    q = _fit(x).withColumn("f", fr.joined(F.col("f"))).withColumn("r", fr.joined(F.col("r")))
    return q.select("sample", "qname", F.size("f").alias("nf"), F.col("f")[0]["s"].alias("fs"), F.col("f")[0]["e"].alias("fe"), F.size("r").alias("nr"), F.col("r")[0]["s"].alias("rs"), F.col("r")[0]["e"].alias("re"))


@query("select sample, qname, chrom, list_aggregate(list_transform(frags, lambda a: concat(a.s, '-', a.e)), 'string_agg', ';') frags, bs bp_start, be bp_end, kind from frags")
def prj_frag(x):
    f = x.frags.select("sample", "qname", "chrom", F.col("frag.frags").alias("frags"), F.col("frag.bp.s").alias("bp_start"), F.col("frag.bp.e").alias("bp_end"), F.col("frag.bp.kind").alias("kind"))
    return f.withColumn("frags", _text_of("frags"))


@query("select widx, id, wtype from windows")
def prj_wtype(x):
    return x.windows.select("widx", "id", fn.window_type(F.col("id"), F.col("chrom")).alias("wtype"))


@query("select distinct chrom, case when regexp_replace(chrom, '^chr', '') in ('X', 'Z') then 1 when regexp_replace(chrom, '^chr', '') in ('Y', 'W') then 2 else 0 end sex from exons")
def prj_sexchr(x):
    return x.exons.select("chrom", fn.sex_chrom(F.col("chrom")).alias("sex")).distinct()


@query("select chrom, rank from chrom_rank")
def prj_chrrank(x):
    return wi.chrom_ranks(x.exons)


CAPTURED_SQL = "select widx, chrom, round(q20, 3) q20 from (select widx, chrom, quantile_cont(fpm, 0.2) q20 from fpm where wtype = 1 group by 1, 2) where q20 > (select quantile_cont(fpm, 0.99) from fpm where wtype = 2)"


@query(CAPTURED_SQL)
def flt_captured(x):
    return mo.captured(x.fpm).select("widx", "chrom", r("q20"))


@query("select widx, chrom, st, en from called")
def flt_nocall(x):
    return x.called.select("widx", "chrom", "st", "en")


@query("select s, cn, first_w, last_w, qs from calls where qs >= 5.0")
def flt_mingq(x):
    return x.calls.where(F.col("qs") >= 5.0)


@query(f"select sample_id sample, {SEX_SQL} sex from metadata where qc <> ''")
def flt_qc_meta(x):
    noted = x.metadata.where("qc <> ''")
    return noted.select(F.col("sample_id").alias("sample"), text.sex_of(F.col("qc"), F.col("sex")).alias("sex"))


# --- joins


@query("select sample, qname, widx from hits")
def join_overlap(x):
    return fr.overlaps(fr.intervals(x.frags), x.windows)


REGIONS_SQL = """select concat('S', lpad(cast(s as string), 2, '0')) sample, case s % 4 when 0 then 'chr1' when 1 then 'chrX' when 2 then 'chrY' else 'chr9' end chrom, cast(s * 700 as bigint) st, cast(s * 700 + 2500 as bigint) en from samples
  union all select concat('S', lpad(cast(s + 12 as string), 2, '0')), 'chr2', cast(210 + 800 * (s % 3) as bigint), cast(290 + 800 * (s % 3) as bigint) from samples"""
REGION_SQL = f"""with g as ({REGIONS_SQL}), k as (select chrom, case when min(wtype) = 0 then 'A' else 'G' end kind from windows where wtype < 2 group by 1),
  n as (select concat('S', lpad(s::string, 2, '0')) sample, cluster_id, left(cluster_id, 1) kind, valid from members join clusters using (cluster_id)),
  j as (select g.*, k.kind, n.cluster_id, n.valid, g.sample in (select sample from n) known from g left join k using (chrom) left join n on n.sample = g.sample and n.kind = k.kind)
  select j.sample, j.chrom, j.st, j.en, j.cluster_id, w.widx, case when not known then 'no such sample' when kind is null then 'no such chromosome' when coalesce(valid, 0) <> 1 then 'cluster not valid' when w.widx is null then 'no exon there' end problem
  from j left join windows w on w.chrom = j.chrom and w.st <= j.en and j.st <= w.en and w.wtype < 2 and case when w.wtype = 0 then 'A' else 'G' end = j.kind and j.valid = 1"""


@query(f"select * from ({REGION_SQL})")
def join_region(x):
    return reuse.exons_of_regions(x.sql(REGIONS_SQL), x.clusters, _members(x), x.windows)


@query("select distinct chrom from alignments where chrom in (select chrom from windows)")
def join_semi_chr(x):
    return x.alignments.select("chrom").distinct().join(x.windows, "chrom", "left_semi")


@query("""select c.s, c.widx, case when c.s < 16 then coalesce(p.n, 0) end n, c.s < 16 done, true same from cells c left join counts p on p.s = c.s and p.widx = c.widx and c.s < 16
  union all select s, widx, null, false, false from cells""")
def join_prev_counts(x):
    """From an earlier run over the same windows, and from one whose windows had more padding, of which nothing is taken."""
    prev = x.cells.where("s < 16").select("s", "widx", "n")
    wider = x.windows.withColumn("en", F.col("en") + PAD)
    runs = [reuse.from_previous(x.samples, x.windows, prev, w).withColumn("same", F.lit(same)) for w, same in ((x.windows, True), (wider, False))]
    return runs[0].unionByName(runs[1])


PREVIOUS = "(select p.i run, s from (values (0), (1), (2), (3)) p(i) cross join samples where s % (p.i + 1) = 0 or s > 20 - p.i)"


def _previous(x):
    runs = x.spark.createDataFrame([(i,) for i in range(4)], "run int")
    return runs.crossJoin(x.samples).where("s % (run + 1) = 0 or s > 20 - run")


BEST_SQL = f"select run, common, others from (select run, count(*) filter (s % 3 = 0) common, count(*) filter (s % 3 <> 0) others from {PREVIOUS} group by run) where common > 0 order by common desc, others, run limit 1"


@query(BEST_SQL)
def join_best_prev(x):
    return reuse.best_previous(_previous(x), x.samples.where("s % 3 = 0"))


ROLE_SQL = "select cluster_id, s, max(role)::int as role from (select cluster_id, s, 1 as role from members union all select c.cluster_id, m.s, 2 from clusters c join members m on list_contains(string_split(c.fit_with, ','), m.cluster_id)) group by 1, 2"


@query(ROLE_SQL)
def join_samp_clust(x):
    return reuse.samples_of_clusters(x.clusters, x.members)


REF_SQL = "select cluster_id, min(f) ref from (select cluster_id, unnest(string_split(fit_with, ',')) f from clusters where fit_with <> '') e where f in (select cluster_id from clusters where fit_with = '') group by 1"


@query(REF_SQL)
def join_refclust(x):
    return reuse.reference_clusters(x.clusters)


@query("select s, cn, first_w, last_w, bp from with_bp where bp is not null")
def join_bp(x):
    c = ca.frag_ratios(x.calls, x.fpm, x.models)
    return ca.with_breakpoints(ca.break_ranges(c, x.windows, x.models, PAD), x.bps).where("bp is not null").select("s", "cn", "first_w", "last_w", "bp")


@query(MERGE_SQL)
def join_merge(x):
    """All sites of four clusters' files by all samples."""
    sites = merging.merged_sites(merging.called_rows(x.spark, _cluster_files(x), list(x.names.values())))
    samples = x.spark.createDataFrame(list(x.names.items()), "s int, sample string")
    return merging.long_rows(sites, samples).join(F.broadcast(samples), "sample").drop("sample")  # a row per sample


PREV_VCF_SQL = """with sig as (select cluster_id, string_agg(s::string, ',' order by s) k from members group by 1), old as (select cluster_id, k from sig where cluster_id not in ('A_03', 'G_02')),
  same as (select n.cluster_id, o.cluster_id prev from sig n join old o on left(n.cluster_id, 1) = left(o.cluster_id, 1) and n.k = o.k join clusters c on c.cluster_id = n.cluster_id where c.valid = 1)
  select s.cluster_id, s.prev from same s where not exists (select 1 from (select cluster_id, unnest(string_split(fit_with, ',')) f from clusters where fit_with <> '') e where e.cluster_id = s.cluster_id and e.f not in (select cluster_id from same))"""


@query()
def join_prev_vcf(x):
    previous = x.members.where("cluster_id <> 'A_03'").withColumn("min_gq", F.when(F.col("cluster_id") == "G_02", "7.0").otherwise("5.0"))
    return reuse.reusable_clusters(x.clusters, x.members, previous, "5.0")


SQL["join_prev_vcf"] = sql("select * from (" + PREV_VCF_SQL + ")")


@query(f"select s, m.sample, batch from (select s, concat('S', s + 1) sample from samples) m join (select sample_id, {BATCH_SQL} batch from metadata) b on b.sample_id = m.sample")
def join_meta(x):
    return x.samples.select("s", F.concat(F.lit("S"), (F.col("s") + 1).cast("string")).alias("sample")).join(_meta(x).select("sample", "batch"), "sample")


# --- aggregations


@query("select a.sample, w.widx, count(h.qname) n from (select distinct sample from alignments) a cross join windows w left join hits h on h.sample = a.sample and h.widx = w.widx group by 1, 2")
def agg_counts(x):
    return fr.counted(fr.overlaps(fr.intervals(x.frags), x.windows), x.alignments.select("sample").distinct(), x.windows)


@query("select * from found_bps")
def agg_bp(x):
    return fr.breakpoints(x.frags)


@query("select s, widx, wtype, n, round(fpm, 6) fpm from fpm")
def agg_fpm(x):
    return x.fpm.select("s", "widx", "wtype", "n", r("fpm", 6))


@query("select round(sd0, 4) sd0, round(fpm_cn0, 4) fpm_cn0 from zero")
def agg_cn0(x):
    return mo.cn0(x.fpm).select(r("sd0", 4), r("fpm_cn0", 4))


@query("select widx, round(quantile_cont(fpm, 0.5), 3) median, quantile_cont(fpm, 0.5) > (select fpm_cn0 from zero) above from autos group by widx")
def agg_median(x):
    m = x.autosomes.groupBy("widx").agg(F.percentile("fpm", 0.5).alias("median"))
    return m.crossJoin(F.broadcast(mo.cn0(x.fpm))).select("widx", r("median"), (F.col("median") > F.col("fpm_cn0")).alias("above"))


@query("select wtype, " + ", ".join(f"round(quantile_cont(fpm, {q}), 3) q{int(q * 100)}" for q in (0.2, 0.5, 0.8, 0.9, 0.99)) + " from fpm group by wtype")
def agg_quantile(x):
    q = mo.typed_quantiles(x.fpm, [0.2, 0.5, 0.8, 0.9, 0.99])
    return q.select("wtype", *[r(c) for c in q.columns[1:]])


@query("select median_len, selected_ied from spacing")
def agg_medlen(x):
    return wi.spacing(x.exons)


@query("select chrom, longest_ied from longest")
def agg_longied(x):
    return wi.longest_gaps(x.exons)


@query("select widx, support from support")
def agg_support(x):
    return x.models.select("widx", F.col("support").cast("long").alias("support"))


@query(f"select i::int cn, (1 + count(st))::bigint n from (select unnest(range(4)) i) left join (select {ARGMAX} st from (select l0 a, l1 b, l2 c, l3 d from lik)) on st = i group by 1")
def agg_states(x):
    return hmm.state_counts(x.lik)


@query("select prev, cur, n, round(p, 6) p from trans")
def agg_trans(x):
    return hmm.transitions(x.lik, x.windows, x.priors, x.cutoffs.max_ied).select("prev", "cur", "n", r("p", 6))


GENDER_SQL = f"""select cluster_id, quantile_cont(sx, 0.5) med_x, quantile_cont(sy, 0.5) med_y from (
  select m.cluster_id, m.s, coalesce(sum(fpm) filter (widx in (select widx from ({CAPTURED_SQL}))), 0) sx, coalesce(sum(fpm) filter (chrom = 'chrY'), 0) sy from members m join fpm using (s) where m.cluster_id like 'G%' group by 1, 2) group by 1"""


def _gender(x):
    return cl.gender(x.fpm.where("wtype = 1"), mo.captured(x.fpm), x.members.where("cluster_id like 'G%'"))


@query(f"select cluster_id, round(med_x, 3) med_x, round(med_y, 3) med_y from ({GENDER_SQL.replace('join fpm using (s)', 'join (select * from fpm where wtype = 1) using (s)')})")
def agg_gender(x):
    return _gender(x).select("cluster_id", r("med_x"), r("med_y"))


@query("select cn, round(quantile_cont(n, 0.8), 6) most from (select samples.s, k.cn, count(c.qs) n from samples cross join (values (0), (1), (3)) k(cn) left join calls c on c.s = samples.s and c.cn = k.cn group by 1, 2) group by cn")
def agg_calls(x):
    return qc.call_quantiles(x.calls, x.samples).select("cn", r("most", 6))


@query("select s, cn, first_w, last_w, round(fr, 6) fr from ratios")
def agg_fragrat(x):
    return ca.frag_ratios(x.calls, x.fpm, x.models).select("s", "cn", "first_w", "last_w", r("fr", 6))


BATCHED_SQL = f"(select m.cluster_id, b.batch, count(*) n from members m join (select sample_id, {BATCH_SQL} batch from metadata) b on b.sample_id = concat('S', m.s + 1) group by 1, 2)"


@query(f"select cluster_id, count(*) n_batches, string_agg(concat(batch, ':', n), ',' order by batch) batches from {BATCHED_SQL} group by 1")
def agg_batch(x):
    m = x.members.select("cluster_id", F.concat(F.lit("S"), (F.col("s") + 1).cast("string")).alias("sample"))
    return qc.batches_of_clusters(m, _meta(x))


@query("with c as (select s, widx, fpm - avg(fpm) over (partition by widx) v from autos) select x.s a, y.s b, round(sum(x.v * y.v) / 1e6, 2) g from c x join c y on x.widx = y.widx and x.s <= y.s group by 1, 2")
def agg_gram(x):
    return cl.gram(x.autosomes).select("a", "b", F.round(F.col("g") / 1e6, 2).alias("g"))


SQL["agg_gram"] = sql("select * from (" + "with c as (select s, widx, fpm - avg(fpm) over (partition by widx) v from autos) select x.s a, y.s b, round(sum(x.v * y.v) / 1e6, 2) g from c x join c y on x.widx = y.widx and x.s <= y.s group by 1, 2)")


@query("select round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 3) icept, round(corr(y, x), 6) r from (select any_value(st % 700 + widx)::double x, avg(fpm) y from autos group by widx)")
def agg_regress(x):
    per = x.autosomes.groupBy("widx").agg(F.avg("fpm").alias("y"), F.first(F.col("st") % 700 + F.col("widx")).cast("double").alias("x"))
    return per.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 3).alias("icept"), F.round(F.corr("y", "x"), 6).alias("r"))


# --- ordered rows


@query("select chrom, st, en, id from merged_exons")
def win_merge(x):
    return wi.merged(x.exons)


@query("select chrom, st, en, id, ied from exon_gaps where ied > 0")
def win_ied_p(x):
    return wi.distances(x.exons).where("ied > 0").select("chrom", "st", "en", "id", "ied")


PSEUDO_SQL = """select chrom, st, en, id from e union all
  select chrom, (prev_end + gap + 1 + i * (median_len + gap))::bigint st, (prev_end + gap + 1 + i * (median_len + gap) + median_len - 1)::bigint en, concat('intergenic_', row_number() over (order by rank, st, en, id, i)) id from (
    select *, floor((ied - k * median_len) / (k + 1))::bigint gap, unnest(range(k)) i from (
      select e.*, rank, median_len, case when ied < longest_ied then greatest(floor((ied - selected_ied) / (selected_ied + median_len))::bigint, 0) else 0 end k
      from e join chrom_rank using (chrom) join (select chrom, greatest(coalesce(max(ied), 0), 0) longest_ied from e group by 1) l using (chrom)
      cross join (select floor(quantile_cont(en - st + 1, 0.5))::bigint median_len, floor(quantile_cont(case when ied > 0 then ied end, 0.8))::bigint selected_ied from e)) where k > 0)"""


@query()
def win_pseudo(x):
    return wi.with_pseudo_exons(written(wi.merged(x.exons), "merged"))


SQL["win_pseudo"] = sql("select * from (with e as (select *, st - prev_end - 1 ied from (select *, max(en) over (partition by chrom order by st, en, id rows between unbounded preceding and 1 preceding) prev_end from merged_exons)) " + PSEUDO_SQL + ")")


@query("select max_ied, dmax from cutoffs")
def win_ied_c(x):
    return wi.gap_cutoffs(x.called)


@query("select prev, cur, count(*) n from moves cross join cutoffs where gap <= max_ied group by 1, 2")
def win_trans(x):
    t = hmm.transitions(x.lik, x.windows, x.priors, x.cutoffs.max_ied)
    return t.where("n > 1").select("prev", "cur", (F.col("n") - 1).cast("long").alias("n"))


@query("select widx, chrom, coalesce(st - lag(en) over (partition by chrom order by widx) - 1, (select dmax from cutoffs)) dist from called")
def win_dist(x):
    lag = F.lag("en").over(Window.partitionBy("chrom").orderBy("widx"))
    return x.called.select("widx", "chrom", F.coalesce(F.col("st") - lag - 1, F.lit(x.cutoffs.dmax)).alias("dist"))


@query("""select t.prev, t.cur, d.d, round(case when d.d >= dmax then q else t.p + (q - t.p) * pow(d.d::double / dmax, 5) end, 6) p
  from trans t cross join (values (0), (100), (799), (1000), (1799), (1800), (5000)) d(d) cross join cutoffs join (select unnest([0, 1, 2, 3]) cur, unnest([p0, p1, p2, p3]) q from prior) q using (cur)""")
def win_adj(x):
    t = hmm.transitions(x.lik, x.windows, x.priors, x.cutoffs.max_ied)
    d = x.spark.createDataFrame([(v,) for v in (0, 100, 799, 1000, 1799, 1800, 5000)], "d int")
    q = F.element_at(F.array(*map(F.lit, x.priors)), F.col("cur") + 1)
    return t.crossJoin(d).select("prev", "cur", "d", F.round(hmm.adjusted(F.col("p"), q, F.col("d"), F.lit(x.cutoffs.dmax)), 6).alias("p"))


@query("select s, cn, first_w, last_w, chrom, pos, end_pos, s1, e1, s2, e2 from ranged")
def win_bpr(x):
    c = ca.frag_ratios(x.calls, x.fpm, x.models)
    return ca.break_ranges(c, x.windows, x.models, PAD).select("s", "cn", "first_w", "last_w", "chrom", "pos", "end_pos", "s1", "e1", "s2", "e2")


THRESHOLD_SQL = "coalesce((select min((med_y + below) / 2) from (select med_y, lag(med_y, 1, 0) over (order by med_y, cluster_id) below from g) where med_y - below > 200), 'infinity'::double)"
GENDERED = "(with g as (" + GENDER_SQL.replace("join fpm using (s)", "join (select * from fpm where wtype = 1) using (s)") + ") select cluster_id, med_x, med_y, " + THRESHOLD_SQL + " threshold from g)"


@query(f"select distinct round(threshold, 3) threshold from {GENDERED}")
def win_firstgap(x):
    return cl.first_gap(_gender(x)).select(r("threshold"))


RUNS_SQL = "select s, state cn, min(widx) first_w, max(widx) last_w, count(*) n from (select *, sum(c) over (partition by s, chrom order by widx) isle from (select s, widx, chrom, state, case when lag(state) over (partition by s, chrom order by widx) = state then 0 else 1 end c from states join windows using (widx))) where state <> 2 group by s, chrom, isle, state"


def _states(x):
    return x.lik.select("s", "widx", mo.best_state(*map(F.lit, x.priors)).alias("state")).join(x.windows.select("widx", "chrom"), "widx")


@query(RUNS_SQL)
def win_runs(x):
    return hmm.runs(_states(x))


RECAL_SQL = """select s, cn, first_w, last_w, round(qs - less, 6) qs from (select c.*, coalesce(l.less, 0) less from calls c left join (
    select cn, qs - 5.0 less from (select cn, qs, row_number() over (partition by cn order by qs desc) k from calls) where k = floor(24 * case cn when 0 then 0.3 when 1 then 0.5 else 0.25 end) + 1) l using (cn)) where qs - less > 5.0"""


@query(RECAL_SQL)
def win_recal(x):
    return ca.recalibrated(x.calls, 24, {0: 0.3, 1: 0.5, 3: 0.25}, 5.0).withColumn("qs", F.round("qs", 6))


@query()
def win_localminmax(x):
    """The first low and the high after it on each sample's density curve."""
    return qc.first_low_and_high(qc.density(x.fpm, 64))


# --- sorting and sets


@query("select chrom, st, en, id, row_number() over (order by rank, st, en, id) - 1 widx from exons join chrom_rank using (chrom)")
def srt_genome(x):
    return wi.genome_sorted(x.exons).drop("rank")


@query("select first_w, last_w, cn, s, row_number() over (order by first_w, last_w, cn, s) place from calls")
def srt_cnv(x):
    order = ["first_w", "last_w", "cn", "s"]
    return numbered(x.calls.select(*order), order)


VCFKEY = """select distinct case p_partkey % 10 when 0 then 'X' when 1 then 'chrY' when 2 then 'M' when 3 then 'chrMT' when 4 then 'chrZ' when 5 then 'W' when 6 then concat('scaffold_', cast(p_size as string))
  when 7 then cast(p_size as string) else concat('chr', cast(p_size as string)) end chrom from part"""


@query(f"""select chrom, case when regexp_matches(b, '^[0-9]+$') then try_cast(b as bigint) when b = 'X' then 1023 when b = 'Y' then 1024 when b in ('M', 'MT') then 1025
  else 1100 + {_digest("b")} end ckey from (select chrom, regexp_replace(chrom, '^chr', '') b from ({VCFKEY}))""")
def srt_vcfkey(x):
    return x.sql(VCFKEY).select("chrom", fn.vcf_key(F.col("chrom")).alias("ckey"))


@query("select cluster_id, n, printf('%s_%02d', left(cluster_id, 1), k) as name from (select cluster_id, count(*) n, row_number() over (partition by left(cluster_id, 1) order by count(*) desc, cluster_id) k from members group by 1)")
def srt_clust(x):
    return reuse.numbered_clusters(x.members)


@query()
def topk_pca(x):
    return cl.pca(x.autosomes).groupBy("dim").agg(F.round(F.max("share"), 6).alias("share"))


@query(BEST_SQL)
def topk_prev(x):
    return reuse.best_previous(_previous(x), x.samples.where("s % 3 = 0"))


@query("select cluster_id, row_number() over (order by fit_with <> '', cluster_id) place from clusters")
def sort_sched(x):
    return numbered(x.clusters.select("cluster_id", (F.col("fit_with") != "").alias("fits")), ["fits", "cluster_id"]).drop("fits")


@query("select distinct s from members where cluster_id in ('A_01', 'G_02')")
def set_union(x):
    return x.members.where("cluster_id = 'A_01'").select("s").unionByName(x.members.where("cluster_id = 'G_02'").select("s")).distinct()


@query("""select (select count(*) from (select chrom, st, en, id from windows except all select chrom, st, en, id from windows)) = 0 same_windows,
  (select count(*) from (select chrom, st, en, id from windows except all select chrom, st, en + 10, id from windows)) = 0 padded_windows,
  (select count(*) from (select s from samples except all select s from samples where s < 16)) + (select count(*) from (select s from samples where s < 16 except all select s from samples)) = 0 same_samples""")
def set_equal(x):
    w = x.windows.select("chrom", "st", "en", "id")
    padded = reuse.equal(w, w.withColumn("en", F.col("en") + PAD)).withColumnRenamed("same", "padded_windows")  # one row each
    return reuse.equal(w, w).withColumnRenamed("same", "same_windows").crossJoin(padded).crossJoin(reuse.equal(x.samples, x.samples.where("s < 16")).withColumnRenamed("same", "same_samples"))


@query("select s from samples where s not in (select s from samples where s < 16)")
def set_diff(x):
    return x.samples.join(x.samples.where("s < 16"), "s", "left_anti")


@query("select sample, count(*) n from hits group by 1")
def set_distinct(x):
    return fr.overlaps(fr.intervals(x.frags), x.windows).groupBy("sample").agg(F.count("*").alias("n"))


@query("select s from samples where s < 16 and s % 3 = 0")
def set_intersect(x):
    return x.samples.where("s < 16").intersect(x.samples.where("s % 3 = 0"))


# --- scalar functions

@query("select distinct cigar, (end_pos - pos + 1)::int len from placed")
def fn_cigarlen(x):
    return x.alignments.select("cigar", fn.cigar_ref_length(F.col("cigar")).alias("len")).distinct()


@query("select distinct cigar, on_read::int first_base from placed")
def fn_firstclip(x):
    return x.alignments.select("cigar", fn.first_unclipped(F.col("cigar")).alias("first_base")).distinct()


@query("select sample, qname, ord, end_pos from placed")
def fn_end(x):
    return fr.placed(x.alignments).select("sample", "qname", "ord", "end_pos")


@query("select flag, (flag & 16) = 16 reverse, (flag & 80) = 64 first_fwd, (flag & 144) = 144 last_rev, (flag & 1804) <> 0 bad, (flag & 2048) = 2048 supp from (select distinct flag from alignments)")
def fn_bits(x):
    f = F.col("flag")
    return x.alignments.select("flag").distinct().select("flag", fn.has_bits(f, 16).alias("reverse"), fn.has_bits(f, 80, 64).alias("first_fwd"), fn.has_bits(f, 144).alias("last_rev"), (~fn.has_bits(f, 1804, 0)).alias("bad"), fn.has_bits(f, 2048).alias("supp"))


def _density(x, name):
    return x.lik.select("s", "widx", F.round(F.col(name) * 1e6, 6).alias("p"))


@query("select s, widx, round(l2 * 1e6, 6) p from lik")
def fn_gauss(x):
    return _density(x, "l2")


@query("select s, widx, round(l0 * 1e6, 6) p from lik")
def fn_halfn(x):
    return _density(x, "l0")


@query("select s, widx, round(l3 * 1e6, 6) p from lik")
def fn_logn(x):
    return _density(x, "l3")


@query(f"select s, widx, {ARGMAX} best from (select s, widx, l0 a, l1 b, l2 c, l3 d from lik)")
def fn_argmax4(x):
    one = F.lit(1.0)
    return x.lik.select("s", "widx", mo.best_state(one, one, one, one).alias("best"))


CUTS = "select distinct cast(1 + l_quantity % 7 as double) / 2 cut from lineitem"


@query(f"""select cut, round(sqrt(sum(v * v * exp(-v * v / 2)) / sum(exp(-v * v / 2))), 8) sd from (
  select cut, ((i + 0.5) / 50000.0::double - 1) * cut v from ({CUTS}) cross join (select unnest(range(100000)) i)) group by cut""")
def fn_erf(x):
    """Spread of a standard normal cut at so many sd."""
    return x.sql(CUTS).select("cut", F.round(fn.truncated_sd(F.col("cut")), 8).alias("sd"))


@query("select s, cn, first_w, last_w, case when cn = 1 or (cn = 3 and fr < 1.9) then '0/1' else '1/1' end gt from rated")
def fn_geno(x):
    c = ca.frag_ratios(x.calls, x.fpm, x.models)
    return c.select("s", "cn", "first_w", "last_w", fn.genotype(F.col("cn"), F.col("fr")).alias("gt"))


@query("select widx, (case when st - 1 <= 0 then 0 else st - 1 + 10 end)::bigint pos, en - 10 end_pos from windows")
def fn_pos(x):
    return x.windows.select("widx", fn.vcf_pos(F.col("st"), PAD).cast("long").alias("pos"), (F.col("en") - PAD).alias("end_pos"))


@query("select s, cn, first_w, round_even(least(qs, 100.0), 0)::int gq, printf('%.2f', qs) fr, format('{:.2e}', qs) sci from calls")
def fn_fmt(x):
    return x.calls.select("s", "cn", "first_w", F.bround(F.least("qs", F.lit(100.0)), 0).cast("int").alias("gq"), F.format_string("%.2f", "qs").alias("fr"), F.format_string("%.2e", "qs").alias("sci"))


@query("select distinct cn, case when cn <= 1 then 'DEL' else 'DUP' end svtype from calls")
def fn_svtype(x):
    return x.calls.select("cn", fn.sv_type(F.col("cn")).alias("svtype")).distinct()


@query("select chrom, id, starts_with(id, 'intergenic_') pseudo, regexp_replace(chrom, '^chr', '') bare, split_part(id, '_', 2) num from windows")
def fn_str(x):
    return x.windows.select("chrom", "id", F.col("id").startswith(fn.INTERGENIC).alias("pseudo"), fn.bare_chrom(F.col("chrom")).alias("bare"), F.split_part("id", F.lit("_"), F.lit(2)).alias("num"))


@query(f"select distinct center, capture, batch_date, {BATCH_SQL} batch from metadata")
def fn_batch(x):
    return x.metadata.select("center", "capture", "batch_date", text.batch(F.col("center"), F.col("capture"), F.col("batch_date")).alias("batch")).distinct()


@query("select distinct chrom, sha256(chrom) h from exons")
def fn_hash(x):
    return x.exons.select("chrom", F.sha2(F.col("chrom").cast("binary"), 256).alias("h")).distinct()


# --- models


@query("select widx, round(mu, 2) mu, round(sd, 2) sd, ok from fitted")
def ml_robust(x):
    return mo.fitted(x.autosomes).select("widx", r("mu", 2), r("sd", 2), "ok")


@query("select widx, ecode from models")
def ml_ecode(x):
    return x.models.select("widx", "ecode")


@query("select s, widx, " + ", ".join(f"round(l{i} * 1e6, 6) l{i}" for i in range(4)) + " from lik")
def ml_lik(x):
    return x.lik.select("s", "widx", *[F.round(F.col(f"l{i}") * 1e6, 6).alias(f"l{i}") for i in range(4)])


@query("select cn::int cn, round(q, 6) q from (select unnest([0, 1, 2, 3]) cn, unnest([p0, p1, p2, p3]) q from prior)")
def ml_priors(x):
    return x.spark.createDataFrame([(i, round(p, 6)) for i, p in enumerate(x.priors)], "cn int, q double")


def _decoded(x, min_gq=5.0):
    m = [[0.0] * 4 for _ in range(4)]
    for t in hmm.transitions(x.lik, x.windows, x.priors, x.cutoffs.max_ied).collect():  # sixteen numbers
        m[t["prev"]][t["cur"]] = t["p"]
    return hmm.viterbi(x.lik, x.windows, {None: (m, x.priors, x.cutoffs.dmax)}, min_gq)


@query()
def ml_viterbi(x):
    return _decoded(x).withColumn("qs", F.round("qs", 6))


@query()
def ml_buildcnv(x):
    """Calls as segments with genomic ends."""
    w = x.windows
    d = _decoded(x).join(w.select(F.col("widx").alias("first_w"), "chrom", "st"), "first_w").join(w.select(F.col("widx").alias("last_w"), "en"), "last_w")
    return d.select("s", "chrom", "st", "en", "cn", fn.sv_type(F.col("cn")).alias("svtype"), F.round("qs", 6).alias("qs"))


HAPLOID = "s % 4 in (1, 3)"  # samples of the male cluster of the fixture


def _haploid_sql(body: str) -> str:
    """The chain of models on the sex chromosomes of the male cluster: no state of one copy, and a state of more copies at twice the mean."""
    out = sql(body)
    for a, b in (
        ("autos as (select * from fpm where wtype = 0)", f"autos as (select * from fpm where wtype = 1 and {HAPLOID})"),
        ("count(*) n from fpm where wtype = 2)", f"count(*) n from fpm where wtype = 2 and {HAPLOID})"),
        ("when mu / 2 - sd <= fpm_cn0 then 1 else 0 end", "else 0 end"),
        ("case when ecode = 1 then 0.0 else exp(-0.5 * ((fpm - mu / 2) / (sd / 2)) ** 2) / (sd / 2 * sqrt(2 * pi())) end l1", "0.0::double l1"),
        ("- ln(mu)) / 0.5", "- ln(2 * mu)) / 0.5"),
    ):
        if a in out:
            out = out.replace(a, b)
    return out


@query()
def ml_ecode_haploid(x):
    return x.pooled_models.where("cluster_id = 'G_02'").select("widx", "ecode")


SQL["ml_ecode_haploid"] = _haploid_sql("select widx, ecode from models")


@query()
def ml_lik_haploid(x):
    d = calling.likelihoods(x.pool, x.pooled_models).where("cluster_id = 'G_02'")
    return d.select("s", "widx", *[F.round(F.col(f"l{i}") * 1e6, 6).alias(f"l{i}") for i in range(4)])


SQL["ml_lik_haploid"] = _haploid_sql("select s, widx, " + ", ".join(f"round(l{i} * 1e6, 6) l{i}" for i in range(4)) + " from lik")


@query("""select a.sample, w.widx, count(h.qname) n, case when substr(a.sample, 2)::int < 16 then 'linked' else 'counted' end how
  from (select distinct sample from alignments) a cross join windows w left join hits h on h.sample = a.sample and h.widx = w.widx group by 1, 2""")
def run_counts(x):
    """Counts of all samples from binary files, by a run that takes up an earlier run over the first sixteen."""
    at, names = _folder(x, "run"), list(x.names.values())
    chroms = [r["chrom"] for r in x.alignments.select("chrom").distinct().orderBy("chrom").collect()]  # names of chromosomes
    bam.write_bam(x.alignments, f"{at}/bams", [(c, 1 << 28) for c in chroms])
    paths, windows = [f"{at}/bams/{n}.bam" for n in names], written(x.windows, "windows")
    run.count(x.spark, paths[:16], windows, f"{at}/one")
    done = run.count(x.spark, paths, windows, f"{at}/two", [f"{at}/one"])
    how = x.spark.createDataFrame([(s, "linked") for s in done.linked] + [(s, "counted") for s in done.counted], "sample string, how string")
    return run.Run(x.spark, f"{at}/two").counts().join(F.broadcast(how), "sample")  # a row per sample


@query()
def run_calls(x):
    """CNVs of all samples of all valid clusters, each by the models of its cluster."""
    found, _ = calling.call(x.fpm, x.clusters, x.members, x.windows)
    return found.withColumn("qs", F.round("qs", 6))


@query()
def run_genotypes(x):
    """From counts to merged genotypes: clusters found and gendered from the counts, called each on its own, merged over all samples."""
    auto, gono = cl.clusters(x.grown, "A", MIN_SAMPLES), cl.clusters(cl.grown(x.fpm.where("wtype = 1")), "G", MIN_SAMPLES)
    found = written(auto.unionByName(gono), "clusters")  # a row per sample and kind
    sexes = cl.gender(x.fpm.where("wtype = 1"), mo.captured(x.fpm), found.where("cluster_id like 'G%'").select("cluster_id", "s")).select("cluster_id", "gender")
    clusters = found.groupBy("cluster_id").agg(F.first("fit_with").alias("fit_with"), F.first("valid").cast("int").alias("valid")).join(sexes, "cluster_id", "left").withColumn("gender", F.coalesce("gender", F.lit("")))
    g = calling.genotypes(written(x.fpm, "fpm"), written(clusters, "judged"), found.select("cluster_id", "s"), x.windows, x.bps, PAD)
    text_ = F.concat_ws(":", "gt", F.col("gq").cast("string"), F.format_string("%.2f", "fr"), "bpr", "bp")
    rows = g.select("chrom", "pos", "end_pos", "alt", "s", text_.alias("text"), F.when(F.col("bp").isNull(), "GT:GQ:FR:BPR").otherwise("GT:GQ:FR:BPR:BP").alias("form"))
    return ca.merged_sites([rows], x.samples)


@query()
def ml_pca(x):
    return cl.pca(x.autosomes).select("s", "dim", r("score", 2), r("share", 6))


@query()
def ml_upgma(x):
    return cl.tree_of(x.grown).withColumn("dist", F.round("dist", 2))


@query()
def ml_blz(x):
    return cl.branch_table(x.grown, MIN_SAMPLES).withColumn("z", F.round("z", 4))


@query()
def ml_l2c(x):
    return cl.clusters(x.grown, "A", MIN_SAMPLES).unionByName(cl.clusters(cl.grown(x.fpm.where("wtype = 1")), "G", MIN_SAMPLES))


@query()
def ml_valid(x):
    return reuse.valid_clusters(x.clusters, x.members, MIN_SAMPLES)


@query(f"select cluster_id, round(med_x, 3) med_x, round(med_y, 3) med_y, case when med_y <= threshold then 'F' else 'M' end gender from {GENDERED}")
def ml_gender(x):
    return _gender(x).select("cluster_id", r("med_x"), r("med_y"), "gender")


@query()
def ml_kde(x):
    return qc.density(x.fpm, 64).select("s", "i", r("x"), F.round(F.col("y") * 1e6, 6).alias("y"))


@query()
def ml_distfit(x):
    return qc.fitted_distributions(x.autosomes)


@query()
def ml_pcaview(x):
    p = cl.pca(x.grown).select("s", "dim", r("score", 2))
    return p.join(cl.clusters(x.grown, "A", MIN_SAMPLES).select("s", "cluster_id"), "s")
