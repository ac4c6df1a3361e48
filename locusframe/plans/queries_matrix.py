"""Matrix roll-up queries."""

from pyspark.sql import functions as F

from locusframe.operators import matrix as mx
from locusframe.plans.catalog import register

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


@register("m1_gene_matrix", "select gene, sample, round(value, 6) as value from fx_matrix")
def m1(v):
    return mx.gene_matrix(v("fx_expr")).select("gene", "sample", *R("value"))


@register("m2_cna_summary", "select gene, round(avg(value / 10 - 2.5), 6) as mean, round(avg((value / 10 - 2.5 >= 1)::int), 6) as amp_freq, round(avg((value / 10 - 2.5 <= -1)::int), 6) as del_freq from fx_expr group by gene")
def m2(v):
    return mx.cna_summary(v("fx_expr").withColumn("value", F.col("value") / 10 - 2.5)).select("gene", *R("mean", "amp_freq", "del_freq"))


PROBES = "select p_partkey as probe, concat('G', cast(p_partkey % 50 as {s}), ';G', cast(p_partkey % 71 as {s})) as genes, case when p_size % 3 = 0 then 'TSS200' else concat('Body;', case when p_size % 2 = 0 then 'TSS1500' else 'Body' end) end as regions from {part}"
PROBE_MAP = f"""probes as ({PROBES.format(s='varchar', part='part')}), z as (select probe, unnest(string_split(genes, ';')) as gene, unnest(case when instr(regions, ';') > 0 then string_split(regions, ';') else [regions, regions] end) as region from probes),
    pm as (select distinct probe, gene from z where region in ('TSS200', 'TSS1500'))"""


def probes(v):
    p = v("part")
    return p.sparkSession.sql(PROBES.format(s="string", part="{p}"), p=p)


@register("m3_probe_map", f"with {PROBE_MAP} select probe, gene from pm")
def m3(v):
    return mx.probe_map(probes(v), ["TSS200", "TSS1500"])


BETAS = "select l_partkey as probe, concat('S', cast(l_suppkey % 40 as {s})) as sample, l_discount * 10 as value, l_partkey * 1000000 + l_orderkey * 10 + l_linenumber as ordinal, l_extendedprice as tie from {lineitem}"


@register("m4_methylation", f"""with {PROBE_MAP}, b as ({BETAS.format(s='varchar', lineitem='lineitem')}), u as (select probe, sample, max(ordinal) as ordinal, arg_max(value, struct_pack(ordinal := ordinal, tie := tie, value := value)) as value from b group by probe, sample),
    o as (select gene, sample, arg_max(value, ordinal) as value from u join pm using (probe) group by gene, sample) select gene, round(avg(value), 6) as beta, count(*) as n from o group by gene""")
def m4(v):
    line = v("lineitem")
    rows = line.sparkSession.sql(BETAS.format(s="string", lineitem="{l}"), l=line)
    rows = rows.groupBy("probe", "sample").agg(F.max("ordinal").alias("ordinal"), F.max_by("value", F.struct("ordinal", "tie", "value")).alias("value"))
    return mx.methylation_mean(rows, mx.probe_map(probes(v), ["TSS200", "TSS1500"])).select("gene", *R("beta"), "n")


@register("m5_protein_summary", "select gene, round(avg(case when value > 10 then value end), 6) as mean, round(avg((value > 10)::int), 6) as detection_rate from fx_expr group by gene")
def m5(v):
    return mx.protein_summary(v("fx_expr").withColumn("value", F.when(F.col("value") > 10, F.col("value")))).select("gene", *R("mean", "detection_rate"))


@register("m6_mutation_evidence", """with u as (select distinct gene from fx_expr), m as (select gene, count(distinct sample) / 177.0 as f, least(1, avg((variant_class = 'click')::int) + 0.6 * avg((variant_class = 'view')::int)) as t from fx_mut group by gene)
    select u.gene, round(coalesce(f, 0), 6) as mut_freq, round(coalesce(t, 0), 6) as mut_type_score from u left join m using (gene)""")
def m6(v):
    return mx.mutation_evidence(v("fx_mut"), 177, v("fx_expr"), ["click"], ["view"]).select("gene", *R("mut_freq", "mut_type_score"))


@register("m7_dependency", """with d as (select gene, value / 25 - 1 as value, coalesce(lineage = 1, false) as inside from fx_matrix left join fx_samples using (sample))
    select gene, round(-avg(value) filter (inside), 6) as absolute, round(-(avg(value) filter (inside) - avg(value) filter (not inside)), 6) as selective from d group by gene""")
def m7(v):
    return mx.dependency(v("fx_matrix").withColumn("value", F.col("value") / 25 - 1), v("fx_samples").where("lineage = 1")).select("gene", *R("absolute", "selective"))


Z = "z as (select gene, sample, (value - avg(value) over (partition by gene)) / case when stddev_pop(value) over (partition by gene) > 0 then stddev_pop(value) over (partition by gene) else 1 end as z from fx_matrix)"
SIGS = "sig as (select distinct gene, case when substr(gene, 2)::int % 4 = 0 then 'basal' else 'classical' end as signature from fx_matrix where substr(gene, 2)::int % 4 < 2)"
SCORES = f"{Z}, {SIGS}, sc as (select sample, signature, avg(z) as score from z join sig using (gene) group by sample, signature)"


def signatures(v):
    n = F.substring("gene", 2, 9).cast("int") % 4
    return v("fx_matrix").select("gene").distinct().where(n < 2).select("gene", F.when(n == 0, "basal").otherwise("classical").alias("signature"))


@register("m8_signature_scores", f"with {SCORES} select sample, signature, round(score, 6) as score from sc")
def m8(v):
    return mx.signature_scores(v("fx_matrix"), signatures(v)).select("sample", "signature", *R("score"))


@register("m9_gene_signature_corr", f"with {SCORES} select gene, signature, round(case when count(*) >= 3 then coalesce(case when var_pop(value) > 0 and var_pop(score) > 0 then corr(value, score) end, 0) else 0 end, 6) as r from fx_matrix join sc using (sample) group by gene, signature")
def m9(v):
    e = v("fx_matrix")
    return mx.gene_signature_corr(e, mx.signature_scores(e, signatures(v))).select("gene", "signature", *R("r"))


CONTRAST = """t as (select gene, avg(log2(value + 1)) as tumor_mean_log, avg((value > 25)::int) as frac_expressed, quantile_cont(value, 0.5) as median from fx_matrix where sample not like '%5' group by gene),
    n as (select gene, avg(value) as normal from fx_matrix where sample like '%5' and substr(gene, 2)::int % 7 <> 0 group by gene)"""


@register("m10_disease_contrast", f"with {CONTRAST} select gene, round(tumor_mean_log, 6) as tumor_mean_log, round(frac_expressed, 6) as frac_expressed, round(median, 6) as median, round(normal, 6) as normal, round(log2(median + 1) - log2(coalesce(normal, 0) + 1), 6) as log2fc from t left join n using (gene)")
def m10(v):
    e = v("fx_matrix")
    normal = e.where("sample like '%5'").where(F.substring("gene", 2, 9).cast("int") % 7 != 0)
    return mx.disease_contrast(e.where("sample not like '%5'"), normal, 25.0).select("gene", *R("tumor_mean_log", "frac_expressed", "median", "normal", "log2fc"))


@register("m11_specificity_z", f"with {CONTRAST} select gene, round((tumor_mean_log - avg(tumor_mean_log) over ()) / (stddev_pop(tumor_mean_log) over () + 1e-9), 6) as z from t")
def m11(v):
    e = v("fx_matrix")
    return mx.specificity_q(mx.disease_contrast(e.where("sample not like '%5'"), e.where("1 = 0"), 25.0), "tumor_mean_log").select("gene", *R("z"))


@register("m12_oncogenic_confidence", "select gene, round(1 / (1 + exp(-(0.4 * (amp - avg(amp) over ()) / (stddev_pop(amp) over () + 1e-9) + 0.3 * det + 0.2 * driver::int))), 6) as oncogenic_confidence from fx_genes")
def m12(v):
    return mx.oncogenic_confidence(v("fx_genes"), "amp", "det", "driver").select("gene", *R("oncogenic_confidence"))


@register("m13_feature_matrix")
def m13(v):
    e = v("fx_matrix")
    few = lambda k: e.select("gene").distinct().where(F.substring("gene", 2, 9).cast("int") % k == 0)
    return mx.feature_matrix(e.where("sample not like '%5'"), e.where("sample like '%5'"), signatures(v), v("fx_mut"), 177, e.withColumn("value", F.col("value") / 25 - 1), v("fx_samples").where("lineage = 1"), few(11), few(17))


CRITERIA_SQL = """c as (select gene, control, (log2fc - min(log2fc) over ()) / (max(log2fc) over () - min(log2fc) over ()) as c_expr, (greatest(amp - del, 0) - min(greatest(amp - del, 0)) over ()) / (max(greatest(amp - del, 0)) over () - min(greatest(amp - del, 0)) over ()) as c_spec,
    (beta - min(beta) over ()) / (max(beta) over () - min(beta) over ()) as c_onc from fx_genes)"""


def criteria(v):
    return mx.criteria(v("fx_genes"), {"c_expr": F.col("log2fc"), "c_spec": F.greatest(F.col("amp") - F.col("del"), F.lit(0.0)), "c_onc": F.col("beta")})


@register("m14_composite_topk", f"""with {CRITERIA_SQL}, s as (select c.gene, g.subtype, round(0.5 * c_expr + 0.3 * c_spec + 0.2 * c_onc, 6) as composite from c join fx_genes g using (gene))
    select gene, subtype, composite from s qualify row_number() over (partition by subtype order by composite desc, gene) <= 15""")
def m14(v):
    rows = mx.composite(criteria(v), {"c_expr": 0.5, "c_spec": 0.3, "c_onc": 0.2}).withColumn("composite", F.round("composite", 6))
    return mx.topk_per(rows, "subtype", "composite", 15, "gene").select("gene", "subtype", "composite")


@register("m15_grid_search", f"""with {CRITERIA_SQL}, l as (select unnest(range(5)) as x), w as (select a.x as a, b.x as b, d.x as d from l a, l b, l d where a.x + b.x + d.x = 4), g as (select row_number() over (order by a, b, d) - 1 as point, a / 4.0 as wa, b / 4.0 as wb, d / 4.0 as wd from w),
    s as (select point, wa, wb, wd, control, gene, round(c_expr * wa + c_spec * wb + c_onc * wd, 12) as s from c, g), k as (select point, wa, wb, wd, control from s qualify row_number() over (partition by point order by s desc, gene) <= 50),
    r as (select point, wa, wb, wd, sum(control::int) as recovery from k group by point, wa, wb, wd) select recovery::bigint as recovery, wa::double as w_c_expr, wb::double as w_c_spec, wd::double as w_c_onc from r
    order by recovery desc, round((wa - 1.0 / 3) * (wa - 1.0 / 3) + (wb - 1.0 / 3) * (wb - 1.0 / 3) + (wd - 1.0 / 3) * (wd - 1.0 / 3), 9), point limit 1""")
def m15(v):
    return mx.grid_search_weights(criteria(v), ["c_expr", "c_spec", "c_onc"], "control", 50, "gene")


GRID = f"""{CRITERIA_SQL}, l as (select unnest(range(5)) as x), w as (select a.x as a, b.x as b, d.x as d from l a, l b, l d where a.x + b.x + d.x = 4), g as (select row_number() over (order by a, b, d) - 1 as point, a / 4.0 as wa, b / 4.0 as wb, d / 4.0 as wd from w),
    s as (select point, wa, wb, wd, control, gene, round(c_expr * wa + c_spec * wb + c_onc * wd, 12) as s from c, g), k as (select point, wa, wb, wd, control, gene from s qualify row_number() over (partition by point order by s desc, gene) <= 50)"""


@register("t21_selection_aware_p", f"""with {GRID}, r as (select point, wa, wb, wd, sum(control::int) as r from k group by all),
    b as (select point as best, r as observed from r order by r desc, round((wa - 1.0 / 3) * (wa - 1.0 / 3) + (wb - 1.0 / 3) * (wb - 1.0 / 3) + (wd - 1.0 / 3) * (wd - 1.0 / 3), 9), point limit 1),
    d as (select turn, gene from fx_genes, (select unnest(range(40)) as turn) qualify row_number() over (partition by turn order by sha256('6' || chr(58) || turn || chr(58) || gene)) <= (select count(*) from fx_genes where control)),
    h as (select turn, point, count(*) as r from k join d using (gene) group by turn, point), e as (select turn, max(r) as r, max(case when point = best then r else 0 end) as naive from h, b group by turn),
    f as (select turn, coalesce(r, 0) as r, coalesce(naive, 0) as naive from (select unnest(range(40)) as turn) left join e using (turn))
    select observed::bigint as observed, count(*) filter (r >= observed) as ge, round((count(*) filter (r >= observed) + 1) / 41.0, 6) as p, count(*) filter (naive >= observed) as naive_ge, round((count(*) filter (naive >= observed) + 1) / 41.0, 6) as naive_p from f, b group by observed""")
def t21(v):
    return mx.selection_aware_p(criteria(v), ["c_expr", "c_spec", "c_onc"], "control", "gene", 50, 40, 6).select("observed", "ge", *R("p"), "naive_ge", *R("naive_p"))


BULK = "m as (select distinct cell, patient from fx_cells where class = 'malignant'), k as (select patient, count(*) as cells from m group by patient having count(*) >= 30)"


@register("m16_pseudobulk", f"with {BULK} select patient, gene, round(sum(n) / max(cells), 6) as mean, max(cells) as cells from fx_cells join m using (cell, patient) join k using (patient) group by patient, gene")
def m16(v):
    c = v("fx_cells")
    return mx.pseudobulk(c, c.select("cell", "patient", "class").distinct(), "malignant").select("patient", "gene", *R("mean"), "cells")


@register("m17_select_genes", """with g as (select gene, avg((value > 1)::int) as share, round(var_pop(value), 9) as variance from fx_matrix group by gene), top as (select gene from g where share > 0.5 order by variance desc, gene limit 60)
    select gene from top union select gene from g where substr(gene, 2)::int % 40 = 0""")
def m17(v):
    e = v("fx_matrix")
    return mx.select_genes(e, 60, e.select("gene").distinct().where(F.substring("gene", 2, 9).cast("int") % 40 == 0))


@register("m18_scale_states", "select gene, sample, round(least(greatest(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) else 0 end, 0.02), 0.98), 6) as state from fx_matrix window w as (partition by gene)")
def m18(v):
    return mx.scale_states(v("fx_matrix")).select("gene", "sample", *R("state"))


@register("m19_call_subtype", f"""with {SCORES}, p as (select sample, max(score) filter (signature = 'basal') as basal, max(score) filter (signature = 'classical') as classical from sc group by sample)
    select sample, case when greatest(basal, classical) <= 0 then 'intermediate' when abs(basal - classical) < 0.2 then 'ambiguous' when basal > classical then 'basal' else 'classical' end as call from p""")
def m19(v):
    wide = mx.signature_scores(v("fx_matrix"), signatures(v)).groupBy("sample").pivot("signature", ["basal", "classical"]).agg(F.first("score"))
    return mx.call_subtype(wide, "basal", "classical").select("sample", "call")


@register("m20_group_diff", """with d as (select gene, value, lineage = 1 as g from fx_matrix join fx_samples using (sample)), k as (select *, rank() over (partition by gene order by value) + (count(*) over (partition by gene, value) - 1) / 2.0 as rk from d),
    s as (select gene, avg(value) filter (g) - avg(value) filter (not g) as diff, count(*) filter (g) as n1, count(*) filter (not g) as n2, sum(rk) filter (g) as r from k group by gene), m as (select unnest([0.0, 1.0]) as margin)
    select gene, margin::double as margin, round(diff, 6) as diff, n1, n2, round(r - n1 * (n1 + 1) / 2, 6) as u, abs(diff) > margin as beyond from s, m where n1 >= 3 and n2 >= 3""")
def m20(v):
    rows = v("fx_matrix").join(v("fx_samples"), "sample").withColumn("g", F.col("lineage") == 1)
    return mx.group_diff(rows, "g", (0.0, 1.0)).select("gene", "margin", *R("diff"), "n1", "n2", *R("u"), "beyond")


@register("d5_universe", "(select gene from fx_mut union select gene from fx_matrix) intersect select gene from fx_genes")
def d5(v):
    return mx.universe([v("fx_mut"), v("fx_matrix")], v("fx_genes"))
