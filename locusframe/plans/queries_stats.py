"""Statistics queries. Replicates are bounded numbers of hash deals; large tables are grouped before they are dealt."""

from pyspark.sql import functions as F

from locusframe.operators import models as md
from locusframe.operators import stats as st
from locusframe.plans.catalog import register

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
RANK = lambda c, part="": f"rank() over ({'partition by ' + part if part else ''} order by {c}) + (count(*) over (partition by {part + ', ' if part else ''}{c}) - 1) / 2.0"
BITS = lambda *parts: f"(('0x' || substr(sha256({' || chr(58) || '.join(parts)}), 1, 12))::bigint / 281474976710656.0::double)"


@register("t1_avg_rank", f"select id, round({RANK('score')}, 6) as rank, round(({RANK('score')} - 1) / (count(*) over () - 1), 6) as rank_pct from fx_labels")
def t1(v):
    return st.avg_rank(v("fx_labels"), "score").select("id", *R("rank", "rank_pct"))


@register("t2_pearson_spearman", f"""with r as (select grp, label, score, {RANK('score', 'grp')} as rx, {RANK('label', 'grp')} as ry from fx_labels)
    select grp, round(case when var_pop(label) > 0 then corr(score, label) end, 6) as pearson, round(case when var_pop(label) > 0 then corr(rx, ry) end, 6) as spearman from r group by grp""")
def t2(v):
    rows = v("fx_labels")
    a = rows.groupBy("grp").agg(st.pearson("score", "label").alias("pearson"))
    return a.join(st.spearman(rows, "score", "label", ["grp"]), "grp").select("grp", *R("pearson", "spearman"))


AUC = lambda label, score, part="": f"round((sum(rk) filter ({label} > 0) - count(*) filter ({label} > 0) * (count(*) filter ({label} > 0) + 1) / 2) / (count(*) filter ({label} > 0) * count(*) filter ({label} = 0)), 6)"


@register("t3_auroc", f"with r as (select *, {RANK('score', 'grp')} as rk from fx_labels) select grp, {AUC('label', 'score')} as auroc, count(*) filter (label > 0) as n_pos, count(*) filter (label = 0) as n_neg from r group by grp")
def t3(v):
    return st.auroc(v("fx_labels"), "label", "score", ["grp"]).select("grp", *R("auroc"), "n_pos", "n_neg")


@register("t3_average_precision", """with c as (select grp, score, sum(label) as p, count(*) as n from fx_labels group by grp, score), r as (select *, sum(p) over w as hits, sum(n) over w as seen from c window w as (partition by grp order by score desc))
    select grp, round(sum(p * hits / seen) / sum(p), 6) as average_precision from r group by grp""")
def t3_ap(v):
    return st.average_precision(v("fx_labels"), "label", "score", ["grp"]).select("grp", *R("average_precision"))


@register("t3_auprc_rows", """with r as (select label, sum(label) over w as hits, row_number() over w as seen from fx_labels window w as (order by score desc, id rows unbounded preceding)) select round(sum(label * hits / seen) / sum(label), 6) as auprc from r""")
def t3_rows(v):
    return st.auprc_rows(v("fx_labels"), "label", "score", "id").select(*R("auprc"))


@register("t3_ndcg", """with a as (select label, row_number() over (order by score desc, id) as r, row_number() over (order by label desc, id) as i from fx_labels) select round(sum(label / log2(r + 1)) filter (r <= 100) / sum(label / log2(i + 1)) filter (i <= 100), 6) as ndcg from a""")
def t3_ndcg(v):
    return st.ndcg(v("fx_labels"), "label", "score", 100, "id").select(*R("ndcg"))


@register("t3_ece", """with b as (select least(floor(score / 40000 * 10), 9) as b, score / 40000 as p, label from fx_labels), c as (select b, count(*) as n, avg(p) as p, avg(label) as y from b group by b) select round(sum(n * abs(p - y)) / sum(n), 6) as ece from c""")
def t3_ece(v):
    return st.ece(v("fx_labels").withColumn("p", F.col("score") / 40000), "label", "p").select(*R("ece"))


@register("t4_grouped_scores", f"""with r as (select split, grp, target, pred_a, {RANK('target', 'split, grp')} as rt, {RANK('pred_a', 'split, grp')} as rp from fx_pred)
    select split, grp, round(corr(target, pred_a), 6) as pearson, round(corr(rt, rp), 6) as spearman, round(avg((sign(target) = sign(pred_a))::int), 6) as direction, round(-avg(abs(ln(1 + greatest(target, 0)) - ln(1 + greatest(pred_a, 0)))), 6) as log1p, round(-avg(abs(asinh(target) - asinh(pred_a))), 6) as asinh
    from r group by split, grp having count(*) > 1""")
def t4(v):
    rows, by = v("fx_pred"), ["split", "grp"]
    names = {"pearson": "pearson", "spearman": "spearman", "direction": "direction_accuracy", "log1p": "neg_mae_log1p", "asinh": "neg_mae_asinh"}
    found = st.grouped_metrics(rows, list(names.values()), "target", "pred_a", by).dropna()
    return found.select(*by, *[F.round(metric, 6).alias(short) for short, metric in names.items()])


P = "p as (select gene, beta * beta + 0.0001 as p from fx_genes)"


@register("t5_bh_fdr", f"""with {P}, r as (select gene, p, p * count(*) over () / (rank() over (order by p) + count(*) over (partition by p) - 1) as raw from p)
    select gene, round(least(1, min(raw) over (order by p rows between current row and unbounded following)), 6) as q, least(1, min(raw) over (order by p rows between current row and unbounded following)) <= 0.05 as rejected from r""")
def t5(v):
    return st.bh_fdr(v("fx_genes").select("gene", (F.col("beta") * F.col("beta") + 0.0001).alias("p")), "p").select("gene", *R("q"), "rejected")


GROUPS = "g as (select grp, avg(target) as x, avg(pred_b) as y from fx_pred group by grp)"


def groups(v):
    return v("fx_pred").groupBy("grp").agg(F.avg("target").alias("x"), F.avg("pred_b").alias("y"))


@register("t6_permutation_p", f"""with {GROUPS}, d as (select r, grp, x, y, row_number() over (partition by r order by grp) as n, row_number() over (partition by r order by sha256('7' || chr(58) || r || chr(58) || grp)) as m from g, (select unnest(range(200)) as r)),
    s as (select a.r, corr(a.x, b.y) as s from d a join d b on a.r = b.r and a.n = b.m group by a.r), o as (select corr(x, y) as observed from g)
    select round(observed, 6) as observed, count(*) filter (abs(s) >= abs(observed) - 1e-12) as ge, round((count(*) filter (abs(s) >= abs(observed) - 1e-12) + 1) / 201.0, 6) as p from s, o group by observed""")
def t6(v):
    return st.permutation_p(groups(v), "x", "y", "grp", 200, 7).select(*R("observed"), "ge", *R("p"))


@register("t7_mann_whitney", f"""with r as (select grp, toxic, score, {RANK('score', 'grp')} as rk from fx_labels) select grp, count(*) filter (toxic > 0) as n1, count(*) filter (toxic = 0) as n2,
    round(sum(rk) filter (toxic > 0) - count(*) filter (toxic > 0) * (count(*) filter (toxic > 0) + 1) / 2, 6) as u from r group by grp having count(*) filter (toxic > 0) > 0 and count(*) filter (toxic = 0) > 0""")
def t7(v):
    return st.mann_whitney(v("fx_labels").withColumn("t", F.col("toxic") > 0), "t", "score", ["grp"]).select("grp", "n1", "n2", *R("u"))


@register("t7_wilcoxon", f"""with d as (select grp, pred_b - target as d from fx_pred where pred_b <> target), r as (select grp, d, rank() over (partition by grp order by abs(d)) + (count(*) over (partition by grp, abs(d)) - 1) / 2.0 as rk, count(*) over (partition by grp) as n, count(*) over (partition by grp, abs(d)) as t from d)
    select grp, count(*) as n, round(coalesce(sum(rk) filter (d > 0), 0), 6) as w_plus, round((coalesce(sum(rk) filter (d > 0), 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2.0 * count(*) + 1) / 24 - sum(t * t - 1.0) / 48), 6) as z from r group by grp""")
def t7w(v):
    return st.wilcoxon(v("fx_pred"), "pred_b", "target", ["grp"]).select("grp", "n", *R("w_plus", "z"))


def poisson(*parts):
    u, out, total, term = BITS(*parts), "0", 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        out += f" + ({u} >= {total!r})::int"
        term /= k + 1
    return f"({out})"


@register("t9_bootstrap_ci", f"""with {GROUPS}, w as (select r, x - y as d, {poisson("'3'", 'r::varchar', 'grp')} as w from g, (select unnest(range(200)) as r)), s as (select r, sum(w * d) / sum(w) as s from w group by r)
    select round((select avg(x - y) from g), 6) as estimate, round(quantile_cont(s, 0.025), 6) as lo, round(quantile_cont(s, 0.975), 6) as hi from s""")
def t9(v):
    return st.paired_bootstrap(groups(v), "x", "y", "grp", 200, 3).select(*R("estimate", "lo", "hi"))


WEIGHTED = f"""{GROUPS}, w as (select r, x - y as d, {poisson("'3'", 'r::varchar', 'grp')} as w from g, (select unnest(range(200)) as r)), e as (select r, d, unnest(range(w)) as i from w where w > 0)"""


@register("t9_bootstrap_median", f"""with {WEIGHTED}, s as (select r, median(d) as m, stddev_samp(d) as s from e group by r) select (select round(median(x - y), 6) from g) as median, round(quantile_cont(m, 0.025), 6) as m_lo, round(quantile_cont(m, 0.975), 6) as m_hi,
    (select round(stddev_samp(x - y), 6) from g) as spread, round(quantile_cont(s, 0.025), 6) as s_lo, round(quantile_cont(s, 0.975), 6) as s_hi from s""")
def t9_median(v):
    rows = groups(v).withColumn("d", F.col("x") - F.col("y"))
    both = [st.bootstrap_ci(rows, "d", "grp", 200, 3, statistic=f).select(F.round("estimate", 6).alias(n), F.round("lo", 6).alias(f"{n[0]}_lo"), F.round("hi", 6).alias(f"{n[0]}_hi")) for n, f in (("median", st.weighted_median), ("spread", st.weighted_spread))]
    return both[0].crossJoin(both[1])


@register("t10_bootstrap_auc", f"""with b as (select id, label, score as a, score * (1 + (id % 7)) as b from fx_labels), w as (select r, label, a, b, case when r < 0 then 1 else {poisson("'5'", 'r::varchar', 'id::varchar')} end as w from b, (select unnest(range(-1, 40)) as r)),
    auc as (select 'a' as k, r, a as s, label, w from w where w > 0 union all select 'b', r, b, label, w from w where w > 0), c as (select k, r, s, sum(w * label) as p, sum(w * (1 - label)) as q from auc group by k, r, s),
    o as (select *, coalesce(sum(q) over (partition by k, r order by s rows between unbounded preceding and 1 preceding), 0) as below from c), e as (select k, r, sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) as auc from o group by k, r),
    d as (select r, max(auc) filter (k = 'a') as auc_a, max(auc) filter (k = 'b') as auc_b from e group by r) select round(max(auc_a) filter (r < 0), 6) as auc_a, round(max(auc_b) filter (r < 0), 6) as auc_b, round(quantile_cont(auc_a - auc_b, 0.025) filter (r >= 0), 6) as lo, round(quantile_cont(auc_a - auc_b, 0.975) filter (r >= 0), 6) as hi from d""")
def t10(v):
    rows = v("fx_labels").withColumn("a", F.col("score")).withColumn("b", F.col("score") * (1 + F.col("id") % 7))
    return st.bootstrap_auc(rows, "label", "a", "b", "id", 40, 5).select(*R("auc_a", "auc_b", "lo", "hi"))


@register("t11_wilson_ci", """with c as (select grp, sum(label)::double as k, count(*)::double as n from fx_labels group by grp), z as (select *, 1.959963984540054::double as z, k / n as p from c)
    select grp, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as lo, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as hi from z""")
def t11(v):
    rows = v("fx_labels").groupBy("grp").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    lo, hi = st.wilson_ci(F.col("k"), F.col("n"))
    return rows.select("grp", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@register("t12_tost", """with s as (select grp, avg(score) filter (label > 0) - avg(score) filter (label = 0) as diff, sqrt(var_samp(score) filter (label > 0) / count(*) filter (label > 0) + var_samp(score) filter (label = 0) / count(*) filter (label = 0)) as se from fx_labels group by grp)
    select grp, round(diff, 6) as diff, round((diff + 500) / se, 6) as t_lower, round((500 - diff) / se, 6) as t_upper from s""")
def t12(v):
    return st.tost(v("fx_labels").withColumn("g", F.col("label") > 0), "g", "score", 500.0, ["grp"]).select("grp", *R("diff", "t_lower", "t_upper"))


@register("t12_tost_paired", """with s as (select grp, avg(pred_a - target) as diff, sqrt(var_samp(pred_a - target) / count(*)) as se, count(*) - 1 as n from fx_pred group by grp having count(*) > 1)
    select grp, round(diff, 6) as diff, n::double as df, round((diff + 500) / se, 6) as t_lower, round((500 - diff) / se, 6) as t_upper from s""")
def t12_paired(v):
    return st.tost_paired(v("fx_pred"), "pred_a", "target", 500.0, ["grp"]).select("grp", F.round("diff", 6).alias("diff"), "df", *R("t_lower", "t_upper"))


@register("t13_conformal", """with e as (select grp, abs(target - pred_a) as e, row_number() over (partition by grp order by abs(target - pred_a)) as r, count(*) over (partition by grp) as n from fx_pred),
    q as (select grp, e as radius from e where r = least(ceil((n + 1) * 0.9), n)) select grp, round(radius, 6) as radius, round(avg((target between pred_b - radius and pred_b + radius)::int), 6) as coverage from q join fx_pred using (grp) group by grp, radius""")
def t13(v):
    rows = v("fx_pred").withColumn("e", F.abs(F.col("target") - F.col("pred_a")))
    radius = st.conformal_radius(rows, "e", 0.9, ["grp"])
    inside = rows.join(F.broadcast(radius), "grp").withColumn("lo", F.col("pred_b") - F.col("radius")).withColumn("hi", F.col("pred_b") + F.col("radius"))
    return st.coverage_rate(inside, "target", "lo", "hi", ["grp"]).join(radius, "grp").select("grp", *R("radius", "coverage"))


@register("t14_jackknife", "select grp, round((sum(score) - max(score)) / (count(*) - 1), 6) as lo, round((sum(score) - min(score)) / (count(*) - 1), 6) as hi, round((max(score) - min(score)) / (count(*) - 1), 6) as range, round(stddev_samp(score) / (count(*) - 1), 6) as std from fx_labels group by grp having count(*) > 1")
def t14(v):
    return st.jackknife(v("fx_labels"), "score", ["grp"]).select("grp", *R("lo", "hi", "range", "std"))


@register("t14_jackknife_variance", """with m as (select grp, avg(score) as m, var_pop(score) as v, count(*) as n from fx_labels group by grp having count(*) > 2), e as (select grp, (n * v - (score - m) * (score - m) * n / (n - 1)) / (n - 2) as e from fx_labels join m using (grp))
    select grp, round(min(e) / 1000, 3) as lo, round(max(e) / 1000, 3) as hi, round((max(e) - min(e)) / 1000, 3) as range, round(stddev_samp(e) / 1000, 3) as std from e group by grp""")
def t14_variance(v):
    return st.jackknife(v("fx_labels"), "score", ["grp"], "variance").select("grp", *[F.round(F.col(c) / 1000, 3).alias(c) for c in ("lo", "hi", "range", "std")])


MATCHED = """c as (select unnest([0.5, 2.0]) as caliper), g as (select gene, driver::int as y, log2fc as s, beta * 20 as c from fx_genes)"""


@register("t17_matched_auc_null", f"""with {MATCHED}, d as (select r, s, c, (row_number() over (partition by r order by sha256('4' || chr(58) || r || chr(58) || gene)) <= (select sum(y) from g))::int as y from g, (select unnest(range(10)) as r)),
    o as (select caliper, count(*) as pairs, avg(case when p.s > n.s then 1.0 when p.s = n.s then 0.5 else 0 end) as concordance from c, g p, g n where p.y > 0 and n.y = 0 and abs(p.c - n.c) <= caliper group by caliper),
    e as (select caliper, p.r, avg(case when p.s > n.s then 1.0 when p.s = n.s then 0.5 else 0 end) as a from c, d p, d n where p.r = n.r and p.y > 0 and n.y = 0 and abs(p.c - n.c) <= caliper group by caliper, p.r)
    select o.caliper::double as caliper, pairs, round(concordance, 6) as concordance, count(*) filter (a >= concordance - 1e-12) as ge from o join e using (caliper) group by all""")
def t17_null(v):
    rows = v("fx_genes").select("gene", F.col("driver").cast("int").alias("y"), F.col("log2fc").alias("s"), (F.col("beta") * 20).alias("c"))
    return st.matched_auc_null(rows, "y", "s", "c", [0.5, 2.0], "gene", 10, 4).select("caliper", "pairs", *R("concordance"), "ge")


@register("t17_matched_auc", """with c as (select unnest([0.5, 2.0]) as caliper), g as (select driver::int as y, log2fc as s, beta * 20 as c from fx_genes)
    select caliper::double as caliper, count(*) as pairs, round(avg(case when p.s > n.s then 1.0 when p.s = n.s then 0.5 else 0 end), 6) as concordance from c, g p, g n where p.y > 0 and n.y = 0 and abs(p.c - n.c) <= caliper group by caliper""")
def t17(v):
    rows = v("fx_genes").select("gene", F.col("driver").cast("int").alias("y"), F.col("log2fc").alias("s"), (F.col("beta") * 20).alias("c"))
    return st.matched_auc(rows, "y", "s", "c", [0.5, 2.0], "gene").select("caliper", "pairs", *R("concordance"))


@register("t18_stratified_auc", f"""with o as (select label, score, row_number() over (order by toxic * 0 + length(grp) * 1000 + id) - 1 as p, count(*) over () as n from fx_labels), b as (select label, score, ntile(3) over (order by p) - 1 as band from o), r as (select *, {RANK('score', 'band')} as rk from b)
    select band, {AUC('label', 'score')} as auroc, count(*) filter (label > 0) as n_pos from r group by band""")
def t18(v):
    rows = v("fx_labels").withColumn("c", F.char_length("grp") * 1000 + F.col("id"))
    return st.stratified_auc(rows, "label", "score", "c", "id", 3).select(F.col("band").cast("long").alias("band"), *R("auroc"), "n_pos")


@register("t19_partial_spearman", f"""with r as (select {RANK('log2fc')} as x, {RANK('det')} as y, {RANK('beta')} as z from fx_genes), c as (select corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz from r) select round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) as partial_spearman from c""")
def t19(v):
    return st.partial_spearman(v("fx_genes"), "log2fc", "det", "beta").select(*R("partial_spearman"))


@register("t19_residual_spearman", f"""with m as (select avg(log2fc) as mx, avg(det) as my, avg(beta) as ma, avg(amp) as mb, var_pop(beta) as va, var_pop(amp) as vb, covar_pop(beta, amp) as ab, covar_pop(log2fc, beta) as xa, covar_pop(log2fc, amp) as xb, covar_pop(det, beta) as ya, covar_pop(det, amp) as yb from fx_genes),
    e as (select round(log2fc - ((xa * vb - xb * ab) * beta + (xb * va - xa * ab) * amp) / (va * vb - ab * ab), 9) as x, round(det - ((ya * vb - yb * ab) * beta + (yb * va - ya * ab) * amp) / (va * vb - ab * ab), 9) as y from fx_genes, m),
    r as (select {RANK('x')} as x, {RANK('y')} as y, count(*) over () as n from e) select round(corr(x, y), 4) as spearman, any_value(n) as n from r""")
def t19_residual(v):
    return st.residual_spearman(v("fx_genes"), "log2fc", "det", ["beta", "amp"]).select(F.round("spearman", 4).alias("spearman"), "n")


@register("t20_spearman_screen", f"""with u as (select log2fc as t, f as feature, case f when 'amp' then amp when 'del' then del when 'beta' then beta else det end as v from fx_genes, (select unnest(['amp', 'del', 'beta', 'det']) as f)),
    r as (select feature, {RANK('v', 'feature')} as rv, {RANK('t', 'feature')} as rt from u) select feature, round(corr(rv, rt), 6) as rho, count(*) as n from r group by feature""")
def t20_spearman(v):
    return st.spearman_screen(v("fx_genes"), "log2fc", ["amp", "del", "beta", "det"]).select("feature", *R("rho"), "n")


@register("t20_univariate_screen", f"""with u as (select control::int as y, f as feature, case f when 'log2fc' then log2fc when 'amp' then amp when 'del' then del when 'beta' then beta else det end as v from fx_genes, (select unnest(['log2fc', 'amp', 'del', 'beta', 'det']) as f)),
    r as (select *, {RANK('v', 'feature')} as rk from u), a as (select feature, (sum(rk) filter (y > 0) - count(*) filter (y > 0) * (count(*) filter (y > 0) + 1) / 2) / (count(*) filter (y > 0) * count(*) filter (y = 0)) as auc from r group by feature)
    select feature, round(auc, 6) as auroc, round(abs(auc - 0.5) * 2, 6) as effect, case when auc >= 0.5 then 'higher' else 'lower' end as direction from a""")
def t20(v):
    rows = v("fx_genes").withColumn("y", F.col("control").cast("int"))
    return st.univariate_screen(rows, "y", ["log2fc", "amp", "del", "beta", "det"]).select("feature", *R("auroc", "effect"), "direction")


@register("t22_set_permutation", """with k as (select count(*) filter (control) as k, avg(beta) filter (control) as observed from fx_genes), d as (select r, beta, row_number() over (partition by r order by sha256('1' || chr(58) || r || chr(58) || gene)) as n from fx_genes, (select unnest(range(50)) as r)),
    s as (select r, avg(beta) as s from d, k where n <= k.k group by r) select round(observed, 6) as observed, count(*) filter (s >= observed - 1e-12) as ge, round((count(*) filter (s >= observed - 1e-12) + 1) / 51.0, 6) as p from s, k group by observed""")
def t22(v):
    return st.set_permutation(v("fx_genes"), "control", "beta", "gene", 50, 1).select(*R("observed"), "ge", *R("p"))


@register("t23_threshold_sweep", f"""with c as (select unnest([0.25, 0.5, 0.9]) as cut), d as (select cut, (beta > cut)::int as y, log2fc as s from fx_genes, c), r as (select *, {RANK('s', 'cut')} as rk from d)
    select cut::double as cut, count(*) filter (y > 0) as n_pos, count(*) filter (y = 0) as n_neg, {AUC('y', 's')} as auroc from r group by cut""")
def t23(v):
    return st.threshold_sweep(v("fx_genes"), "beta", "log2fc", [0.25, 0.5, 0.9]).select("cut", "n_pos", "n_neg", *R("auroc"))


@register("t23_threshold_sweep_ci", f"""with c as (select unnest([0.25, 0.5]) as cut), d as (select cut, r, beta, log2fc as s, {poisson("'6'", 'r::varchar', 'gene')} as w from fx_genes, c, (select unnest(range(20)) as r)),
    k as (select cut, r, s, sum(w * (beta > cut)::int) as p, sum(w * (beta <= cut)::int) as q from d where w > 0 group by cut, r, s), o as (select *, coalesce(sum(q) over (partition by cut, r order by s rows between unbounded preceding and 1 preceding), 0) as below from k),
    a as (select cut, r, sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) as auc from o group by cut, r) select cut::double as cut, round(quantile_cont(auc, 0.025), 6) as lo, round(quantile_cont(auc, 0.975), 6) as hi from a group by cut""")
def t23_ci(v):
    return st.threshold_sweep_ci(v("fx_genes"), "beta", "log2fc", [0.25, 0.5], "gene", 20, 6).select("cut", *R("lo", "hi"))


@register("t24_precision_at_k", "with r as (select control, row_number() over (order by beta desc, gene) as r from fx_genes), k as (select unnest([10, 100]) as k) select k::int as k, round(sum(control::int) / k, 6) as precision from k join r on r.r <= k.k group by k")
def t24(v):
    return st.precision_at_k(v("fx_genes"), "control", "beta", [10, 100], "gene").select("k", *R("precision"))


@register("t25_cv_auc")
def t25(v):
    rows = v("fx_genes").withColumn("y", (F.col("log2fc") + F.col("beta") > 0.8).cast("double"))
    return md.cv_auc(rows, ["amp", "beta", "det", "del"], "y", "gene").select("seed", F.round("auroc", 2).alias("auroc"), "n_pos", "n_neg")


@register("t25_cv_variants")
def t25_variants(v):
    rows = v("fx_genes").withColumn("y", (F.col("log2fc") + F.col("beta") > 0.8).cast("double"))
    features = ["amp", "beta", "det"]
    one = md.cv_univariate(rows, features, "y", "gene", folds=2).select(F.concat(F.lit("only "), "feature").alias("what"), F.round("auroc", 2).alias("value"))
    gone = md.cv_ablation(rows, features, "y", "gene", folds=2).select(F.concat(F.lit("without "), F.coalesce("without", F.lit("none"))).alias("what"), F.round("auroc", 2).alias("value"))
    null = md.cv_null(rows, ["beta"], "y", "gene", 4, folds=2).select(F.lit("p").alias("what"), F.col("p").alias("value"))
    return one.unionByName(gone).unionByName(null)


@register("t26_permutation_importance")
def t26(v):
    rows = v("fx_genes").withColumn("y", (F.col("log2fc") + F.col("beta") > 0.8).cast("double"))
    features = ["amp", "beta", "det"]
    model = md.fit_classifier(rows, features, "y")
    return md.permutation_importance(model, rows, features, "y", "gene")


@register("t27_to_unit", "select a.gene, round((select count(*) from fx_genes t where t.amp <= a.beta) / (select count(*) from fx_genes)::double, 6) as unit from fx_genes a")
def t27(v):
    rows = v("fx_genes")
    return md.to_unit(rows.select("gene", "beta"), "beta", rows, "amp").select("gene", *R("unit"))


@register("t27_regressor")
def t27_fit(v):
    rows = v("fx_genes").withColumn("y", F.col("log2fc") * F.col("beta"))
    train = rows.where(F.pmod(F.xxhash64("gene"), F.lit(5)) > 0)
    model = md.fit_regressor(train, ["log2fc", "beta", "det"], "y", "forest")
    return md.predicted(model, rows).select("gene", (md.blend("prediction", "beta", 0.7)).alias("blend"))
