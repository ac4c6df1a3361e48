"""Interval and chromatin queries."""

from pyspark.sql import functions as F

from locusframe.operators import chromatin as ch
from locusframe.operators import intervals as iv
from locusframe.operators import matrix as mx
from locusframe.plans.catalog import register

MEET = "a.chrom = b.chrom and a.start_pos < b.end_pos and a.end_pos > b.start_pos"
BEST = f"select a.locus_id, coalesce(max(b.signal), 0) as best, count(b.peak_id) > 0 as hit from fx_windows2k a left join fx_peaks b on {MEET} group by a.locus_id"


@register("flagship_loci", f"""with b as ({BEST}), e as (select min(best) as lo, max(best) as hi from b)
    select locus_id, hit, round(0.7 * (best - lo) / (hi - lo) + 0.3 * cast(hit as int), 6) as composite from b, e order by composite desc, locus_id limit 20""")
def flagship(v):
    loci = iv.overlap_max(v("fx_windows2k"), v("fx_peaks"), "signal", "locus_id", flag="hit")
    scored = mx.criteria(loci, {"c_signal": F.col("best")}).select("locus_id", "hit", F.round(0.7 * F.col("c_signal") + 0.3 * F.col("hit").cast("int"), 6).alias("composite"))
    return scored.orderBy(F.desc("composite"), "locus_id").limit(20)


@register("j1_overlap_join", f"select a.locus_id, b.peak_id from fx_windows2k a join fx_peaks b on {MEET}")
def j1(v):
    return iv.overlap_pairs(v("fx_windows2k"), v("fx_peaks"), "locus_id", "peak_id")


@register("j2_overlap_flag", f"select locus_id, hit from ({BEST})")
def j2(v):
    return iv.overlap_flag(v("fx_windows2k"), v("fx_peaks"), "hit", "locus_id").select("locus_id", "hit")


@register("j3_overlap_semi", f"select peak_id from fx_peaks a where exists (select 1 from fx_windows2k b where {MEET})")
def j3(v):
    return iv.overlap_semi(v("fx_peaks"), v("fx_windows2k"), "peak_id").select("peak_id")


@register("j4_overlap_anti", f"select peak_id from fx_peaks a where not exists (select 1 from fx_windows2k b where {MEET})")
def j4(v):
    return iv.overlap_anti(v("fx_peaks"), v("fx_windows2k"), "peak_id").select("peak_id")


@register("j5_overlap_max", f"select locus_id, round(best, 6) as best from ({BEST})")
def j5(v):
    return iv.overlap_max(v("fx_windows2k"), v("fx_peaks"), "signal", "locus_id").select("locus_id", F.round("best", 6).alias("best"))


ISLANDS = """fx as (select chrom, start_pos, end_pos, max(end_pos) over (partition by chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from fx_peaks),
    numbered as (select *, sum(case when start_pos <= reach then 0 else 1 end) over (partition by chrom order by start_pos, end_pos rows unbounded preceding) as k from fx),
    merged as (select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n from numbered group by chrom, k)"""


@register("j6_merge_intervals", f"with {ISLANDS} select chrom, start_pos, end_pos, n from merged")
def j6(v):
    return iv.merge_intervals(v("fx_peaks"))


@register("j7_points_in_regions", f"with {ISLANDS} select locus_id, tss from fx_loci p where exists (select 1 from merged m where m.chrom = p.chrom and p.tss between m.start_pos and m.end_pos)")
def j7(v):
    return iv.points_in_regions(v("fx_loci"), v("fx_peaks"), "tss").select("locus_id", "tss")


@register("j8_nearest_distance", """select l.locus_id, min(abs(l.tss - p.start_pos)) as distance from fx_loci l left join fx_peaks p on l.chrom = p.chrom group by l.locus_id""")
def j8(v):
    points = v("fx_peaks").select("chrom", F.col("start_pos").alias("tss"))
    return iv.nearest_distance(v("fx_loci"), points, "tss").select("locus_id", "distance")


@register("j9_window_mean", f"select a.locus_id, round(avg(b.value), 6) as mean from fx_windows2k a left join fx_track b on {MEET} group by a.locus_id")
def j9(v):
    return iv.window_mean(v("fx_windows2k"), v("fx_track"), "locus_id").select("locus_id", F.round("mean", 6).alias("mean"))


READS = "select chrom, case when side = 'F' then start_pos else greatest(0, end_pos - 150) end as start_pos, case when side = 'F' then start_pos + 150 else end_pos end as end_pos from fx_track"


@register("j10_coverage", f"""with b as ({READS}) select a.locus_id, round(coalesce(sum(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) filter (b.chrom is not null), 0) / 2000.0, 6) as depth
    from fx_windows2k a left join b on {MEET} group by a.locus_id""")
def j10(v):
    reads = v("fx_track").withColumn("strand", F.when(F.col("side") == "F", "+").otherwise("-"))
    return iv.coverage(iv.extend_reads(reads, 150), v("fx_windows2k"), "locus_id").select("locus_id", F.round("depth", 6).alias("depth"))


@register("j10_coverage_per_base", f"""with b as ({READS}) select locus_id, pos, count(*) as depth from (
    select a.locus_id, unnest(generate_series(greatest(a.start_pos, b.start_pos), least(a.end_pos, b.end_pos) - 1)) as pos from fx_windows2k a join b on {MEET}) group by locus_id, pos""")
def j10_bases(v):
    reads = v("fx_track").withColumn("strand", F.when(F.col("side") == "F", "+").otherwise("-"))
    return iv.coverage(iv.extend_reads(reads, 150), v("fx_windows2k"), "locus_id", per_base=True)


@register("j10_coverage_runs", f"""with b as ({READS}), p as (select locus_id, greatest(a.start_pos, b.start_pos) as lo, least(a.end_pos, b.end_pos) as hi from fx_windows2k a join b on {MEET}),
    e as (select locus_id, pos, sum(d) as d from (select locus_id, lo as pos, 1 as d from p union all select locus_id, hi, -1 from p) group by locus_id, pos),
    r as (select locus_id, pos as start_pos, lead(pos) over w as end_pos, sum(d) over w as depth from e where d <> 0 window w as (partition by locus_id order by pos))
    select locus_id, start_pos, end_pos, depth::bigint as depth from r where depth > 0""")
def j10_runs(v):
    reads = v("fx_track").withColumn("strand", F.when(F.col("side") == "F", "+").otherwise("-"))
    return iv.coverage_runs(iv.extend_reads(reads, 150), v("fx_windows2k"), "locus_id").select("locus_id", "start_pos", "end_pos", F.col("depth").cast("long").alias("depth"))


@register("j11_tss_window", """select locus_id, greatest(0, case when strand = '+' then tss - 2000 else tss - 500 end) as start_pos, case when strand = '+' then tss + 500 else tss + 2000 end as end_pos from fx_loci""")
def j11(v):
    return iv.tss_window(v("fx_loci"), 2000, 500).select("locus_id", "start_pos", "end_pos")


@register("j12_mark_calls", f"""with c as (select a.locus_id, b.name as mark, b.peak_id % 2 as side from fx_windows2k a join fx_peaks b on {MEET}),
    f as (select l.locus_id, coalesce(bool_or(mark = 'click' and side = 0), false) as click_case, coalesce(bool_or(mark = 'click' and side = 1), false) as click_control,
    coalesce(bool_or(mark = 'view' and side = 0), false) as view_case, coalesce(bool_or(mark = 'view' and side = 1), false) as view_control from fx_windows2k l left join c using (locus_id) group by l.locus_id)
    select *, click_case and not click_control as click_gain, view_case and not view_control as view_gain from f""")
def j12(v):
    peaks = v("fx_peaks").withColumnRenamed("name", "mark")
    return iv.mark_calls(v("fx_windows2k"), peaks.where("peak_id % 2 = 0"), peaks.where("peak_id % 2 = 1"), ["click", "view"], "locus_id")


@register("j13_spaced_topk", """with recursive o as (select *, row_number() over (partition by chrom order by signal desc, start_pos, end_pos) as r from (select chrom, start_pos, end_pos, max(signal) as signal from fx_peaks group by all)),
    g as (select distinct chrom, 0::bigint as r, []::bigint[] as kept, false as taken from o union all
      select g.chrom, o.r, case when len(g.kept) < 20 and len(list_filter(g.kept, lambda x: abs(x - o.start_pos) < 5000)) = 0 then list_append(g.kept, o.start_pos) else g.kept end, len(g.kept) < 20 and len(list_filter(g.kept, lambda x: abs(x - o.start_pos) < 5000)) = 0
      from g join o on o.chrom = g.chrom and o.r = g.r + 1)
    select o.chrom, start_pos, end_pos, signal from g join o on o.chrom = g.chrom and o.r = g.r where taken""")
def j13(v):
    return iv.spaced_topk(v("fx_peaks"), "chrom", 5000, 20)


@register("j14_duplication_audit", """with d as (select chrom, (start_pos // 50) as start_pos, 0 as end_pos from fx_peaks), c as (select chrom, start_pos, count(*) as n from d group by chrom, start_pos)
    select chrom, sum(n)::bigint as n, count(*) as n_distinct, round(1 - count(*) / sum(n), 6) as redundant, round(sum(n) / count(*), 6) as factor from c group by rollup (chrom)""")
def j14(v):
    rows = v("fx_peaks").select("chrom", F.expr("start_pos div 50").alias("start_pos"), F.lit(0).alias("end_pos"))
    return iv.duplication_audit(rows).select("chrom", "n", "n_distinct", F.round("redundant", 6).alias("redundant"), F.round("factor", 6).alias("factor"))


LEVELS = "select locus, mark, max(level) as level from fx_marks group by locus, mark"
PIVOT = "select locus, " + ", ".join(f"coalesce(max(level) filter (mark = '{m}'), 0) as {m}" for m in ch.MARKS) + f" from ({LEVELS}) group by locus"


@register("h1_enrichment", """with r as (select concat('G', cast(l_partkey % 50 as varchar)) as locus, l_linestatus as mark, l_returnflag as replicate, l_quantity as value, l_linenumber = 1 as bg from lineitem),
    g as (select mark, replicate, avg(value) as g from r where bg group by mark, replicate), o as (select mark, replicate, locus, avg(value) as v from r where not bg group by mark, replicate, locus)
    select mark, locus, round(avg(v / g), 6) as level from o join g using (mark, replicate) where g > 0 group by mark, locus""")
def h1(v):
    rows = v("lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.concat(F.lit("G"), (F.col("l_partkey") % 50).cast("string"))).alias("locus"), F.col("l_linestatus").alias("mark"), F.col("l_returnflag").alias("replicate"), F.col("l_quantity").alias("value"))
    return ch.enrichment(rows).select("mark", "locus", F.round("level", 6).alias("level"))


@register("h2_classify_mark", """select locus, mark, case upper(mark) when 'H3K27AC' then 'active_enhancer_promoter' when 'H3K4ME1' then 'enhancer' when 'H3K4ME3' then 'promoter' when 'H3K27ME3' then 'repressed'
    when 'H3K9ME3' then 'heterochromatin' when 'H3K36ME3' then 'transcribed' else 'tf' end as class, count(*) as n from fx_marks group by locus, mark""")
def h2(v):
    return v("fx_marks").groupBy("locus", "mark").agg(F.count("*").alias("n")).withColumn("class", ch.classify_mark("mark"))


@register("h3_chromatin_state", f"""select locus, case when H3K4me3 > 2 and H3K27me3 > 2 then 'bivalent_poised' when H3K4me3 > 2 and H3K27ac > 0.8 then 'active_promoter' when H3K4me1 > 2 and H3K27ac > 2 and H3K4me3 < 2 then 'active_enhancer'
    when H3K4me1 > 2 and H3K27ac <= 0.8 then 'poised_enhancer' when H3K27me3 > 2 then 'polycomb_repressed' when H3K9me3 > 2 then 'heterochromatin' when H3K36me3 > 2 then 'transcribed' when CTCF > 2 then 'insulator' else 'quiescent' end as state from ({PIVOT})""")
def h3(v):
    return ch.mark_levels(v("fx_marks"), "locus").select("locus", ch.chromatin_state().alias("state"))


@register("h4_chromatin_features", f"""select locus, round((H3K27ac + H3K4me1 + H3K4me3 + H3K9ac) / 4, 6) as active_signal, round((H3K27me3 + H3K9me3) / 2, 6) as repressive_signal, round(least(H3K4me3, H3K27me3), 6) as bivalency,
    round(((H3K27ac + H3K4me1 + H3K4me3 + H3K9ac) / 4 - (H3K27me3 + H3K9me3) / 2) / ((H3K27ac + H3K4me1 + H3K4me3 + H3K9ac) / 4 + (H3K27me3 + H3K9me3) / 2 + 1e-6), 6) as activity_score from ({PIVOT})""")
def h4(v):
    out = ch.chromatin_features(ch.mark_levels(v("fx_marks"), "locus"))
    return out.select("locus", *[F.round(c, 6).alias(c) for c in ("active_signal", "repressive_signal", "bivalency", "activity_score")])


@register("h5_summit_features", """with e as (select vec_id, list_transform(embedding, lambda x: abs(x)::double) as c from embeddings),
    p as (select vec_id, c, list_max(c) as top, len(c) as n, list_filter(range(len(c)), lambda i: c[i + 1] >= list_max(c) / 2) as above from e)
    select vec_id, round(top, 6) as summit, list_position(c, top) - 1 as summit_pos, list_max(above) - list_min(above) as fwhm,
    round(least(list_max(c[1 : n // 2]), list_max(c[n // 2 + 1 : n])) / (list_avg(c[n // 2 - n // 10 + 1 : n // 2 + n // 10]) + 1e-6), 6) as bimodality from p""")
def h5(v):
    rows = v("embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("c")).withColumn("s", ch.summit_features("c"))
    return rows.select("vec_id", F.round("s.summit", 6).alias("summit"), F.col("s.summit_pos").cast("long").alias("summit_pos"), F.col("s.fwhm").cast("long").alias("fwhm"), F.round("s.bimodality", 6).alias("bimodality"))


RESIDUAL = f"""with c as (select a.locus_id, avg(b.value) as v from fx_windows2k a join fx_track b on {MEET} where b.side = 'F' group by a.locus_id), o as (select a.locus_id, avg(b.value) as v from fx_windows2k a join fx_track b on {MEET} where b.side = 'O' group by a.locus_id),
    r as (select l.locus_id, l.strand, log2((c.v + 1) / (o.v + 1)) as residual from fx_windows2k l left join c using (locus_id) left join o using (locus_id))"""


def residuals(v):
    t = v("fx_track")
    return ch.log2_residual(v("fx_windows2k"), t.where("side = 'F'"), t.where("side = 'O'"), "locus_id")


@register("h6_log2_residual", f"{RESIDUAL} select locus_id, round(residual, 6) as residual from r")
def h6(v):
    return residuals(v).select("locus_id", F.round("residual", 6).alias("residual"))


@register("h7_set_contrast", f"""{RESIDUAL}, k as (select locus_id, locus_id % 25 = 0 as t, residual, rank() over (order by residual) + (count(*) over (partition by residual) - 1) / 2.0 as rk from r where residual is not null)
    select round(avg(residual) filter (t), 6) as target_mean, round(avg(residual) filter (not t), 6) as background_mean, round(avg((residual > 0)::int) filter (t), 6) as target_up, round(avg((residual > 0)::int) filter (not t), 6) as background_up,
    round(sum(rk) filter (t) - count(*) filter (t) * (count(*) filter (t) + 1) / 2, 6) as u from k""")
def h7(v):
    rows = residuals(v).withColumn("t", F.col("locus_id") % 25 == 0)
    return ch.set_contrast(rows, "t", "residual").select(*[F.round(c, 6).alias(c) for c in ("target_mean", "background_mean", "target_up", "background_up", "u")])


@register("h8_caliper_match")
def h8(v):
    rows = v("fx_genes").withColumn("t", F.expr("cast(substring(gene, 2) as int) % 50 = 0"))
    return ch.caliper_match(rows, "t", "log2fc", "gene", 0.2, 3)


@register("h9_window_sweep", f"""{RESIDUAL}, s as (select unnest([0.5, 1.0, 2.0]) as cut) select cut, count(*) filter (residual > cut) as n_up, round(avg(residual) filter (abs(residual) > cut), 6) as mean from r, s where residual is not null group by cut""")
def h9(v):
    rows = ch.sweep(residuals(v).where("residual is not null").select("residual"), "cut", (0.5, 1.0, 2.0))
    return rows.groupBy("cut").agg(F.sum((F.col("residual") > F.col("cut")).cast("long")).alias("n_up"), F.round(F.avg(F.when(F.abs("residual") > F.col("cut"), F.col("residual"))), 6).alias("mean"))


#: The upper normal tail by the power series of the error function.
TAIL = lambda z: f"0.5 * (1 - 2 / sqrt(pi()) * list_sum(list_transform(range(90), lambda i: pow(-1, i) * pow(({z}) / sqrt(2), 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))))"


@register("h9_residual_sweep", f"""with w as (select unnest([500, 1000, 3000]) as width), q as (select unnest([0.5, 1.0, 5.0])::double as pseudo),
    m as (select width, l.locus_id, avg(b.value) filter (b.side = 'F') as c, avg(b.value) filter (b.side = 'O') as o from fx_loci l, w, fx_track b where l.chrom = b.chrom and b.start_pos < l.tss + width and b.end_pos > l.tss - width group by width, l.locus_id),
    r as (select width, pseudo, locus_id, locus_id % 25 = 0 as t, round(log2((c + pseudo) / (o + pseudo)), 9) as v from m, q where c is not null and o is not null),
    k as (select *, rank() over (partition by width, pseudo order by v) + (count(*) over (partition by width, pseudo, v) - 1) / 2.0 as rk, count(*) over (partition by width, pseudo, v) as same from r),
    s as (select width, pseudo, count(*)::double as n, (count(*) filter (t))::double as n1, avg(v) filter (t) as target_mean, avg(v) filter (not t) as background_mean, sum(rk) filter (t) - count(*) filter (t) * (count(*) filter (t) + 1) / 2 as u, sum(same::double * same - 1) as ties from k group by all),
    d as (select width, pseudo, turn, v, row_number() over (partition by width, pseudo, turn order by sha256('3' || chr(58) || turn || chr(58) || locus_id)) as i from r, (select unnest(range(20)) as turn) where not t),
    e as (select width, pseudo, turn, avg(v) as m from d join s using (width, pseudo) where i <= n1 group by all),
    g as (select width, pseudo, count(*) filter (m >= target_mean - 1e-12) as ge from e join s using (width, pseudo) group by all),
    z as (select *, n1 * (n - n1) as nn, sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) as sd from s)
    select width::bigint as width, pseudo, n::bigint as n, n1::bigint as n_target, round(target_mean, 6) as target_mean, round(background_mean, 6) as background_mean, round(u, 6) as u, round({TAIL('(u - nn / 2 - 0.5) / sd')}, 6) as p, ge as set_ge, round(ge / 20.0, 6) as set_p from z left join g using (width, pseudo)""")
def h9_sweep(v):
    t = v("fx_track")
    loci = v("fx_loci").withColumn("t", F.col("locus_id") % 25 == 0)
    out = ch.residual_sweep(loci, t.where("side = 'F'"), t.where("side = 'O'"), "locus_id", "t", (500, 1000, 3000), (0.5, 1.0, 5.0), 20, 3)
    return out.select("width", "pseudo", "n", "n_target", *[F.round(c, 6).alias(c) for c in ("target_mean", "background_mean", "u", "p")], "set_ge", F.round("set_p", 6).alias("set_p"))


@register("h9_caliper_sweep")  # matching closest pairs first is a walk: tests hold it against a plain one
def h9_calipers(v):
    rows = v("fx_genes").withColumn("t", F.expr("cast(substring(gene, 2) as int) % 50 = 0"))
    return ch.caliper_sweep(rows, "t", "beta", "log2fc", "gene", (0.1, 0.25, 0.5))


@register("h10_leave_one_out", f"""with t as (select gene as dropped, beta as x from fx_genes where control), b as (select beta as y from fx_genes where not control),
    c as (select beta, count(*)::double as n from fx_genes group by beta), s as (select (select count(*) from t) - 1.0 as n1, (select count(*) from b)::double as n2, (select sum(n * n * n - n) from c) as ties, (select sum(x) from t) as total),
    w as (select dropped, x, sum(case when y < x then 1.0 when y = x then 0.5 else 0 end) as w from t, b group by dropped, x),
    r as (select dropped, (total - x) / n1 as mean, (select sum(w) from w) - w as u, n1 * n2 as nn, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - (ties - (n * n * n - n) + ((n - 1) * (n - 1) * (n - 1) - (n - 1))) / ((n1 + n2) * (n1 + n2 - 1)))) as sd from w join c on c.beta = x, s),
    q as (select dropped, mean, u, {TAIL('(u - nn / 2 - 0.5) / sd')} as p from r)
    select dropped, round(mean, 6) as mean, round(u, 6) as u, round(p, 6) as p, round(max(p) over (), 6) as worst from q""")
def h10(v):
    return ch.leave_one_out(v("fx_genes"), "control", "beta", "gene").select("dropped", *[F.round(c, 6).alias(c) for c in ("mean", "u", "p", "worst")])


@register("h11_genome3d", f"""with e as (select a.locus_id, avg(b.value - 25000) as eigenvector, avg(b.value) filter (b.side = 'F') as insulation from fx_windows2k a join fx_track b on {MEET} group by a.locus_id),
    d as (select l.locus_id, min(abs(l.tss - p.start_pos)) as distance from fx_loci l left join fx_peaks p on l.chrom = p.chrom and p.peak_id % 10 = 0 group by l.locus_id)
    select d.locus_id, round(eigenvector, 6) as eigenvector, round(insulation, 6) as insulation, distance, case when eigenvector > 0 then 'A' when eigenvector < 0 then 'B' end as compartment from d left join e using (locus_id)""")
def h11(v):
    t, loci = v("fx_track"), v("fx_windows2k")
    edges = v("fx_peaks").where("peak_id % 10 = 0").select("chrom", F.col("start_pos").alias("pos"))
    out = ch.genome3d_features(loci, t.withColumn("value", F.col("value") - 25000), t.where("side = 'F'"), edges, "locus_id")
    return out.select("locus_id", F.round("eigenvector", 6).alias("eigenvector"), F.round("insulation", 6).alias("insulation"), "distance", "compartment")


@register("h12_fisher_enrichment", """with f as (select count(*) filter (driver and beta > 0.5) as a, count(*) filter (driver and not beta > 0.5) as b, count(*) filter (not driver and beta > 0.5) as c, count(*) filter (not driver and not beta > 0.5) as d from fx_genes)
    select a, b, c, d, round(a * d / (b * c)::double, 6) as odds_ratio from f""")
def h12(v):
    out = ch.fisher_enrichment(v("fx_genes").withColumn("high", F.col("beta") > 0.5), "driver", "high")
    return out.select("a", "b", "c", "d", F.round("odds_ratio", 6).alias("odds_ratio"))
