"""The chain of derived tables in the oracle's SQL, on top of the shared inputs."""

from __future__ import annotations

from .fixture import TABLES, closure

ARGMAX = "case when a >= b and a >= c and a >= d then 0 when b >= c and b >= d then 1 when c >= d then 2 else 3 end"

DERIVED = {
    "totals": "select s, sum(case when wtype = 0 then n else 0 end)::bigint auto_sum, sum(n)::bigint all_sum from cells group by s",
    "fpm": "select c.*, c.n * 1e6::double / greatest(case when wtype = 0 then auto_sum else all_sum end, 1) fpm from cells c join totals using (s)",
    "zero": "select sd + sd / (4 * n) sd0, (sd + sd / (4 * n)) * 1.959963984540054 fpm_cn0 from (select sqrt(avg(fpm * fpm)) sd, count(*) n from fpm where wtype = 2)",
    "autos": "select * from fpm where wtype = 0",
    "fit0": "select widx, quantile_cont(fpm, 0.5) median, stddev_pop(fpm) / 3 sd0, count(*) n from autos group by widx",
    "fits(widx, it, mu, sd, ok, done)": """select widx, 0, median, sd0, false, median <= 0 from fit0 union all
      select widx, it + 1, case when k = 0 then mu else m end, case when k = 0 then sd else v end, k > 0 and m <> 0 and abs(m - mu) + abs(v - sd) <= 1e-5, k = 0 or abs(m - mu) + abs(v - sd) <= 1e-5
      from (select f.widx, f.it, f.mu, f.sd, count(a.fpm) k, avg(a.fpm) m, stddev_pop(a.fpm) / 0.8796256610342398 v
        from fits f left join autos a on a.widx = f.widx and abs(a.fpm - f.mu) < 2 * f.sd where f.it < 200 and not f.done group by all)""",
    "fitted": """select f.widx, f.mu, case when f.ok and f.sd = 0 then f.mu * 0.05 else f.sd end sd, f.ok, g.median, g.n
      from (select widx, max(it) it, max_by(mu, it) mu, max_by(sd, it) sd, max_by(ok, it) ok from fits group by widx) f join fit0 g using (widx)""",
    "support": "select f.widx, count(*) filter (abs(a.fpm - f.mu) < 2 * f.sd) support from fitted f join autos a using (widx) group by 1",
    "models": """select f.widx, median, mu, sd, support, sd0, fpm_cn0, case when median <= fpm_cn0 then -1 when not ok then -2 when support < 0.5 * n then -3
      when mu - 2.0 * sd <= fpm_cn0 then -4 when mu / 2 - sd <= fpm_cn0 then 1 else 0 end ecode from fitted f join support using (widx) cross join zero""",
    "lik": """select s, widx, fpm, mu, 2.0 / (sd0 * sqrt(2 * pi())) * exp(-(fpm * fpm) / (2 * sd0 * sd0)) l0,
      case when ecode = 1 then 0.0 else exp(-0.5 * ((fpm - mu / 2) / (sd / 2)) ** 2) / (sd / 2 * sqrt(2 * pi())) end l1, exp(-0.5 * ((fpm - mu) / sd) ** 2) / (sd * sqrt(2 * pi())) l2,
      case when fpm > mu + 2 * sd then exp(-0.5 * ((ln(fpm - mu - 2 * sd) - ln(mu)) / 0.5) ** 2) / ((fpm - mu - 2 * sd) * 0.5 * sqrt(2 * pi())) else 0.0 end l3
      from autos join models using (widx) where ecode >= 0""",
    "pri(it, p0, p1, p2, p3, t, done)": f"""select 0, 1.0::double, 1.0::double, 1.0::double, 1.0::double, '', false union all
      select it + 1, case when done then p0 else q0 end, case when done then p1 else q1 end, case when done then p2 else q2 end, case when done then p3 else q3 end,
        case when done then t else u end, done or t = u from (
          select *, format('{{:.2e}} {{:.2e}} {{:.2e}} {{:.2e}}', q0, q1, q2, q3) u from (
            select it, p0, p1, p2, p3, t, done, {', '.join(f'(1 + count(*) filter (st = {i}))::double / (4 + count(*)) q{i}' for i in range(4))}
            from (select *, {ARGMAX} st from (select p.*, l0 * p0 a, l1 * p1 b, l2 * p2 c, l3 * p3 d from pri p cross join lik where p.it < 20)) group by all))""",
    "prior": "select p0, p1, p2, p3 from pri where it = 20",
    "states": f"select s, widx, {ARGMAX} state from (select s, widx, l0 * p0 a, l1 * p1 b, l2 * p2 c, l3 * p3 d from lik cross join prior)",
    "called": "select windows.* from windows join models using (widx) where ecode >= 0",
    "gaps": "select widx, chrom, st, en, st - lag(en) over (partition by chrom order by widx) gap from called",
    "cutoffs": "select floor(quantile_cont(gap, 0.5))::bigint max_ied, floor(quantile_cont(gap, 0.9))::bigint dmax from gaps",
    "moves": "select lag(state) over w prev, state cur, st - lag(en) over w gap from states join windows using (widx) window w as (partition by s, chrom order by widx)",
    "trans": """select prev, cur, n, n::double / sum(n) over (partition by prev) p from (
      select a.i::int prev, b.i::int cur, (1 + count(m.prev))::bigint n from (select unnest(range(4)) i) a cross join (select unnest(range(4)) i) b
      left join (select prev, cur from moves cross join cutoffs where gap <= max_ied) m on m.prev = a.i and m.cur = b.i group by 1, 2)""",
    "sorted_exons": "select *, max(en) over (partition by chrom order by st, en, id rows between unbounded preceding and 1 preceding) prev_end from exons",
    "exon_gaps": "select *, st - prev_end - 1 ied from sorted_exons",
    "spacing": "select floor(quantile_cont(en - st + 1, 0.5))::bigint median_len, floor(quantile_cont(case when ied > 0 then ied end, 0.8))::bigint selected_ied from exon_gaps",
    "longest": "select chrom, greatest(coalesce(max(ied), 0), 0) longest_ied from exon_gaps group by chrom",
    "isles": "select *, sum(case when prev_end >= st then 0 else 1 end) over (partition by chrom order by st, en, id) isle from sorted_exons",
    "merged_exons": "select chrom, min(st) st, max(en) en, string_agg(id, '-' order by st, en, id) id from isles group by chrom, isle",
    "merged_prev": "select *, max(en) over (partition by chrom order by st, en, id rows between unbounded preceding and 1 preceding) prev_end from merged_exons",
    "chrom_rank": """select chrom, dense_rank() over (order by kind, num, bare, chrom)::int rank from (
      select chrom, bare, case when regexp_matches(bare, '^[0-9]+$') then 0 when bare = 'X' then 1 when bare = 'Y' then 2 when bare = 'M' then 3 when bare = 'MT' then 4 else 5 end kind, try_cast(bare as bigint) num
      from (select distinct chrom, regexp_replace(chrom, '^chr', '') bare from exons))""",
    "placed": """select *, pos + coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: x::bigint)), 0)::bigint - 1 end_pos,
      1 + coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(cigar, '^(([0-9]+[HS])*)', 1), '([0-9]+)[HS]', 1), lambda x: x::bigint)), 0)::bigint on_read from alignments""",
    "usable": "select * from placed where mapq >= 20 and (flag & 1) = 1 and (flag & 1804) = 0",
    "known": "select * from usable where chrom in (select chrom from windows)",
    "qn": """select sample, qname, min(chrom) chrom, count(distinct chrom) chroms, count(distinct ((flag & 80) = 64 or (flag & 144) = 144)) orients,
      list({'o': on_read, 'd': ord, 's': pos, 'e': end_pos} order by ord) filter ((flag & 16) = 0) f0, list({'o': on_read, 'd': ord, 's': pos, 'e': end_pos} order by ord) filter ((flag & 16) = 16) r0
      from known group by 1, 2""",
    "fitq": "select * from qn where chroms = 1 and orients = 1 and len(f0) between 1 and 2 and len(r0) between 1 and 2",
    "ordered": """select sample, qname, chrom, case when len(f0) = 2 and f0[1].o > f0[2].o then list_reverse(f0) else f0 end f, case when len(r0) = 2 and r0[1].o > r0[2].o then list_reverse(r0) else r0 end r from fitq""",
    "strands": """select sample, qname, chrom, """
    + ", ".join(
        f"case when len({x}) = 2 and least({x}[1].e, {x}[2].e) > greatest({x}[1].s, {x}[2].s) then 1 else len({x}) end n{x}, "
        f"case when len({x}) = 2 and least({x}[1].e, {x}[2].e) > greatest({x}[1].s, {x}[2].s) then least({x}[1].s, {x}[2].s) else {x}[1].s end {x}1s, "
        f"case when len({x}) = 2 and least({x}[1].e, {x}[2].e) > greatest({x}[1].s, {x}[2].s) then greatest({x}[1].e, {x}[2].e) else {x}[1].e end {x}1e, {x}[2].s {x}2s, {x}[2].e {x}2e"
        for x in ("f", "r")
    )
    + " from ordered",
    "facing": """select *, case when nf = 2 and nr = 2 then null when a_s <= b_e and a_e >= b_s and not (nf = 1 and nr = 1 and a_s >= b_e) then [{'s': least(a_s, b_s), 'e': greatest(a_e, b_e)}]
      when a_s <= b_e and not (nf = 1 and nr = 1 and a_s >= b_e) and b_s - a_e <= 1000 then [{'s': a_s, 'e': a_e}, {'s': b_s, 'e': b_e}] end b from (
        select *, case when nf = 2 then f2s else f1s end a_s, case when nf = 2 then f2e else f1e end a_e, case when nr = 2 then r2s else r1s end b_s, case when nr = 2 then r2e else r1e end b_e from strands)""",
    "explained": """select sample, qname, chrom, case
      when nf = 2 and nr = 2 then case
        when not (f1s <= r2e and f1e >= r2s and f2s <= r1e and f2e >= r1s) then null
        when f1s < f2s and r1s > r2s then {'frags': [{'s': least(f1s, r2s), 'e': greatest(f1e, r2e)}, {'s': least(f2s, r1s), 'e': greatest(f2e, r1e)}], 'bs': greatest(f1e, r2e), 'be': least(f2s, r1s), 'kind': 'DEL'}
        when f1s > f2s and r1s < r2s then {'frags': [{'s': least(f2s, r1s), 'e': greatest(f2e, r1e)}, {'s': least(f1s, r2s), 'e': greatest(f1e, r2e)}], 'bs': least(f2s, r1s), 'be': greatest(f1e, r2e), 'kind': 'DUP'} end
      when b is null then null
      when nf = 1 and nr = 1 then {'frags': b, 'bs': null, 'be': null, 'kind': null}
      when nf = 2 then case
        when f1s < f2s then case when f1e < b[1].s then {'frags': list_concat([{'s': f1s, 'e': f1e}], b), 'bs': f1e, 'be': b[1].s, 'kind': 'DEL'} end
        when b[-1].e < f1s then {'frags': list_concat(b, [{'s': f1s, 'e': f1e}]), 'bs': b[1].s, 'be': f1e, 'kind': 'DUP'}
        when b[-1].s < f1e then {'frags': list_concat(b[:-2], [{'s': least(b[-1].s, f1s), 'e': greatest(b[-1].e, f1e)}]), 'bs': case when len(b) = 1 then least(b[1].s, f1s) else b[1].s end, 'be': greatest(b[-1].e, f1e), 'kind': 'DUP'} end
      else case
        when r2s < r1s then case when b[-1].e < r1s then {'frags': list_concat(b, [{'s': r1s, 'e': r1e}]), 'bs': b[-1].e, 'be': r1s, 'kind': 'DEL'} end
        when r1e < b[1].s then {'frags': list_concat([{'s': r1s, 'e': r1e}], b), 'bs': r1s, 'be': b[-1].e, 'kind': 'DUP'}
        when b[1].s < r1e then {'frags': list_concat([{'s': least(b[1].s, r1s), 'e': greatest(b[1].e, r1e)}], b[2:]), 'bs': least(b[1].s, r1s), 'be': case when len(b) = 1 then greatest(b[-1].e, r1e) else b[-1].e end, 'kind': 'DUP'} end
      end x from facing""",
    "frags": "select sample, qname, chrom, x.frags frags, x.bs::bigint bs, x.be::bigint be, x.kind kind from explained where x is not null",
    "hits": "select distinct sample, qname, widx from (select sample, qname, chrom, unnest(frags) i from frags) f join windows w on w.chrom = f.chrom and f.i.s < w.en and w.st < f.i.e",
    "found_bps": "select sample, chrom, bs bp_start, be bp_end, kind cnvtype, count(*) n_qnames, string_agg(qname, ',' order by qname) qnames from frags where kind is not null group by 1, 2, 3, 4, 5",
    "ratios": "select calls.s, calls.cn, first_w, last_w, avg(fpm / mu) fr from calls join autos on autos.s = calls.s and autos.widx between first_w and last_w join models using (widx) where ecode >= 0 group by 1, 2, 3, 4",
    "rated": "select calls.*, fr from calls join ratios using (s, cn, first_w, last_w)",
    "edges": """select w.widx, w.chrom, w.st, w.en, coalesce(last_value(case when ecode >= 0 then w.en end ignore nulls) over (partition by w.chrom order by w.widx rows between unbounded preceding and 1 preceding) + 1, 0) s1,
      coalesce(first_value(case when ecode >= 0 then w.st end ignore nulls) over (partition by w.chrom order by w.widx rows between 1 following and unbounded following) - 1, arg_max(w.st, w.widx) over (partition by w.chrom) - 1) e2
      from windows w left join models using (widx)""",
    "ranged": """select c.*, a.chrom, case when a.st - 1 <= 0 then 0 else a.st - 1 + 10 end::bigint pos, (z.en - 10)::bigint end_pos, a.s1, case when a.st - 1 <= 0 then 0 else a.st - 1 + 10 end::bigint e1, (z.en - 10 + 1)::bigint s2, z.e2
      from rated c join edges a on a.widx = first_w join edges z on z.widx = last_w""",
    "with_bp": """select r.*, b.bp from ranged r left join (
      select r.s, r.cn, r.first_w, r.last_w, string_agg(concat(bp_start, '-', bp_end, '-', n_qnames), ',' order by bp_start, bp_end, n_qnames) bp from ranged r join bps b
      on b.s = r.s and b.chrom = r.chrom and b.cnvtype = case when r.cn <= 1 then 'DEL' else 'DUP' end and bp_start between s1 and e1 and bp_end between s2 and e2 and n_qnames >= 2 group by 1, 2, 3, 4) b using (s, cn, first_w, last_w)""",
    "geno": """select chrom, pos, end_pos, concat('<', case when cn <= 1 then 'DEL' else 'DUP' end, '>') alt, s, case when cn = 1 or (cn = 3 and fr < 1.9) then '0/1' else '1/1' end gt,
      round_even(least(qs, 100.0), 0)::int gq, round(fr, 2) fr, concat(s1, '-', e1, ',', s2, '-', e2) bpr, bp from with_bp""",
    "geno_text": "select chrom, pos, end_pos, alt, s, concat_ws(':', gt, gq, printf('%.2f', fr), bpr, bp) as text from geno",
}

ALL = {**TABLES, **{k.split("(")[0]: v for k, v in DERIVED.items()}}
HEADS = {k.split("(")[0]: k for k in DERIVED}


def sql(body: str) -> str:
    """A query with every table it needs."""
    ctes = closure(body, ALL)
    for name, head in HEADS.items():
        if head != name:
            ctes = ctes.replace(f"{name} as (", f"{head} as (", 1) if ctes.startswith(f"{name} as (") else ctes.replace(f"\n{name} as (", f"\n{head} as (", 1)
    return f"with recursive {ctes}\n{body}" if ctes else body
