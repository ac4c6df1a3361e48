"""Ranking queries."""

import math

from pyspark.sql import functions as F

from locusframe.operators import rank as rk
from locusframe.plans.catalog import register
from locusframe.plans.queries_stats import BITS

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
DOM = "a.efficacy >= b.efficacy and a.specificity >= b.specificity and a.robustness >= b.robustness and a.safety >= b.safety and (a.efficacy > b.efficacy or a.specificity > b.specificity or a.robustness > b.robustness or a.safety > b.safety)"


def fronts_sql(n, source="fx_scores"):
    out = [f"l0 as (select * from {source})"]
    for k in range(n):
        out.append(f"f{k} as (select b.* from l{k} b where not exists (select 1 from l{k} a where {DOM}))")
        out.append(f"l{k + 1} as (select * from l{k} where id not in (select id from f{k}))")
    return ", ".join(out)


@register("r1_subscores", """select gene, round(case when least(greatest(least(beta, 1), 0), greatest(least(det, 1), 0), greatest(least(amp, 1), 0)) <= 0 then 0 else exp((ln(nullif(greatest(least(beta, 1), 0), 0)) + ln(nullif(greatest(least(det, 1), 0), 0)) + ln(nullif(greatest(least(amp, 1), 0), 0))) / 3) end, 12) as efficacy,
    round(greatest(0, least(1, 0.5 * greatest(0, least(1, beta)) + 0.5 * greatest(0, least(1, det)) - greatest(del, 0))), 12) as specificity, round((1 - greatest(0, least(1, del))) * (1 - greatest(0, least(1, amp))) * (1 - greatest(0, least(1, beta))), 12) as safety from fx_genes""")
def r1(v):
    return v("fx_genes").select("gene", F.round(rk.efficacy("beta", "det", "amp"), 12).alias("efficacy"), F.round(rk.specificity("beta", "det", "del"), 12).alias("specificity"), F.round(rk.safety("del", "amp", "beta"), 12).alias("safety"))


@register("r1_composite", "select id, round(0.4 * efficacy + 0.3 * specificity + 0.2 * robustness + 0.1 * safety, 6) as composite from fx_scores")
def r1_composite(v):
    return v("fx_scores").select("id", F.round(rk.composite(weights=(4, 3, 2, 1)), 6).alias("composite"))


@register("r2_dominance", f"select b.id, coalesce(list(a.id order by a.id) filter (a.id is not null), []) as dominated_by from fx_scores b left join fx_scores a on {DOM} group by b.id")
def r2(v):
    return rk.dominance(v("fx_scores"), "id")


@register("r3_pareto_fronts")  # as many fronts as there are: more than SQL can name; tests hold it against brute force
def r3(v):
    return rk.pareto_fronts(v("fx_scores"), "id").select("id", "rank")


CROWD = f"""{fronts_sql(2)}, r as (select *, 0 as rank from f0 union all select *, 1 from f1), u as (select id, rank, o, case o when 'efficacy' then efficacy when 'specificity' then specificity when 'robustness' then robustness else safety end as x from r, (select unnest(['efficacy', 'specificity', 'robustness', 'safety']) as o)),
    n as (select *, lag(x) over w as b, lead(x) over w as a, max(x) over (partition by rank, o) - min(x) over (partition by rank, o) as wd from u window w as (partition by rank, o order by x, id)),
    c as (select id, rank, sum(case when a is null or b is null then 'infinity'::double when wd > 0 then (a - b) / wd else 0 end) as crowding from n group by id, rank)"""


def ranked(v, fronts=None):
    return rk.crowding(rk.pareto_fronts(v("fx_scores"), "id", max_rank=fronts).where("rank is not null"), "id")


@register("r4_crowding")  # over all fronts, as r3
def r4(v):
    return ranked(v).select("id", "rank", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


@register("r4_crowding_first_fronts", f"with {CROWD} select id, rank, case when crowding = 'infinity'::double then -1 else round(crowding, 6) end as crowding from c")
def r4_first(v):
    return ranked(v, 2).where("rank is not null").select("id", F.col("rank").cast("long").alias("rank"), F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


@register("r5_select_top", f"with {CROWD} select id from c where rank = 0 order by crowding desc, id limit 10")
def r5(v):
    return rk.select_top(ranked(v, 2), 10, "id").select("id")


@register("r5_select_preferred", f"with {fronts_sql(1)} select id, round(0.25 * efficacy + 0.25 * specificity + 0.25 * robustness + 0.25 * safety, 6) as composite from f0 order by round(0.25 * efficacy + 0.25 * specificity + 0.25 * robustness + 0.25 * safety, 12) desc, id limit 10")
def r5_preferred(v):
    return rk.select_top(rk.pareto_fronts(v("fx_scores"), "id", max_rank=1).where("rank = 0"), 10, "id", (1, 1, 1, 1)).select("id", *R("composite"))


def noisy(o: str) -> str:
    return f"least(1, greatest(0, {o} + 0.02::double * sqrt(-2 * ln(greatest({BITS(_q('0'), 'r::varchar', 'id::varchar', _q(o), _q('1'))}, 1e-12))) * cos({2 * math.pi!r}::double * {BITS(_q('0'), 'r::varchar', 'id::varchar', _q(o), _q('2'))}))) as {o}"


_q = "'{}'".format
BEATEN = f"{' and '.join(f'y.{o} >= x.{o}' for o in rk.OBJECTIVES)} and ({' or '.join(f'y.{o} > x.{o}' for o in rk.OBJECTIVES)})"


@register("r6_front_membership", f"""with f as (select * from fx_scores x where not exists (select 1 from fx_scores y where {BEATEN})), d as (select id, r, {', '.join(noisy(o) for o in rk.OBJECTIVES)} from f, (select unnest(range(20)) as r)),
    w as (select id, count(*) / 20 as p from d x where not exists (select 1 from d y where y.r = x.r and {BEATEN}) group by id) select f.id, coalesce(p, 0) as p from f left join w using (id)""")
def r6(v):
    return rk.front_membership(rk.front(v("fx_scores")), "id", 20)


@register("r7_floors_report", """with g as (select id, 0 as o, 'efficacy' as objective, round(0.5 - efficacy, 12) as gap from fx_scores union all select id, 1, 'safety', round(0.6 - safety, 12) from fx_scores), m as (select * from g where gap > 0 order by gap, id, o limit 1)
    select (select count(*) from fx_scores) as candidates, (select count(*) from fx_scores where efficacy >= 0.5 and safety >= 0.6) as passing, objective as binding, id as closest, round(gap, 6) as gap from m""")
def r7(v):
    return rk.floors_report(v("fx_scores"), "id", {"efficacy": 0.5, "safety": 0.6}).select("candidates", "passing", "binding", "closest", *R("gap"))


@register("r8_design_space", "select p.p_partkey as promoter, e.s_suppkey as enhancer, n.n_nationkey as guide, p.p_size % 25 as target from part p join supplier e on e.s_nationkey = p.p_size % 25 join nation n on n.n_nationkey = p.p_size % 25")
def r8(v):
    return rk.design_space(v("part").select((F.col("p_size") % 25).alias("target"), F.col("p_partkey").alias("promoter")), v("supplier").select(F.col("s_nationkey").alias("target"), F.col("s_suppkey").alias("enhancer")), v("nation").select(F.col("n_nationkey").alias("target"), F.col("n_nationkey").alias("guide")))


@register("r8_pairs", "select a.s_suppkey as a, b.s_suppkey as b, l as logic from supplier a join supplier b on a.s_suppkey < b.s_suppkey, (select unnest(['AND', 'OR']) as l)")
def r8_pairs(v):
    return rk.pairs(v("supplier"), "s_suppkey")


@register("r9_dossier", """with m as (select gene, avg(value) as expr from fx_matrix group by gene), k as (select gene, count(*) as mutations from fx_mut group by gene), d as (select g.gene, coalesce(log2fc > 0.3, false) as a, coalesce(expr > 25, false) as b, coalesce(mutations > 20, false) as c from fx_genes g left join m using (gene) left join k using (gene))
    select gene, a::int * 1.0 + b::int * 0.5 + c::int * 1.0 as score, concat_ws('; ', case when a then 'up in disease' end, case when b then 'expressed' end, case when c then 'mutated' end) as reasons,
    case when a::int * 1.0 + b::int * 0.5 + c::int * 1.0 >= 2 then 'strong' when a::int * 1.0 + b::int * 0.5 + c::int * 1.0 >= 1 then 'moderate' else 'weak' end as verdict from d""")
def r9(v):
    layers = [v("fx_matrix").groupBy("gene").agg(F.avg("value").alias("expr")), v("fx_mut").groupBy("gene").agg(F.count("*").alias("mutations"))]
    return rk.dossier(v("fx_genes"), layers, [("log2fc > 0.3", 1.0, "up in disease"), ("expr > 25", 0.5, "expressed"), ("mutations > 20", 1.0, "mutated")]).select("gene", "score", "reasons", "verdict")


@register("r10_convergence_score", """with m as (select gene, substr(gene, 2)::int % 6 as master_rank, substr(gene, 2)::int % 9 as motif_targets from fx_genes)
    select gene, round(0.28e0 * (det * 0.9973e0 + 0.000137e0) + 0.20e0 * greatest(0, least(1, log2fc / 4)) + 0.16e0 * master_rank / 5 + 0.12e0 * motif_targets / 8 + 0.12e0 * greatest(0, least(1, amp / 0.3e0)) + 0.06e0 * driver::int + 0.06e0 * (subtype <> '')::int - case when beta > 0.5e0 then 0.15e0 * greatest(0, least(1, (beta - 0.5e0) / 0.5e0)) else 0 end, 4) as convergence_score from fx_genes join m using (gene)""")
def r10(v):
    n = F.substring("gene", 2, 9).cast("int")
    out = rk.convergence_score(v("fx_genes").withColumn("master_rank", n % 6).withColumn("motif_targets", n % 9).withColumn("percentile", F.col("det") * 0.9973 + 0.000137), "percentile", 5)
    return out.select("gene", "convergence_score")


ROLES = [("G1", "driver", ["repress"], "allow"), ("G2", "suppressor", ["activate"], "block"), ("G3", "state", ["repress"], "quarantine"), ("G4", "lineage", ["activate"], "allow")]


def gated(v):
    rows = v("fx_genes").withColumn("full", F.col("gene")).withColumn("gene", F.concat(F.lit("G"), (F.substring("gene", 2, 9).cast("int") % 6).cast("string")))
    rows = rows.withColumn("direction", F.when(F.col("log2fc") > 0.2, "repress").otherwise("activate"))
    spark = rows.sparkSession
    roles = spark.createDataFrame(ROLES, "gene string, role string, admissible array<string>, status string")
    return rk.direction_gate(rows, roles, "direction", spark.createDataFrame([("G3", "basal", "repress")], "gene string, subtype string, direction string"), "basal")


@register("r11_direction_gate", """with g as (select gene, substr(gene, 2)::int % 6 as k, case when log2fc > 0.2 then 'repress' else 'activate' end as d from fx_genes)
    select gene, case k when 1 then 'driver' when 2 then 'suppressor' when 3 then 'state' when 4 then 'lineage' else 'unclassified' end as role, case k when 1 then case d when 'repress' then 'allow' else 'block' end when 2 then case d when 'activate' then 'quarantine' else 'block' end
    when 3 then case d when 'repress' then 'allow' else 'quarantine' end when 4 then case d when 'activate' then 'allow' else 'block' end else 'quarantine' end as status from g""")
def r11(v):
    return gated(v).select(F.col("full").alias("gene"), "role", "status")


@register("r12_direction_score", """with p as (select gene, case when log2fc > 0.2 then 1 else -1 end as s, 0.30 * greatest(-1, least(1, log2fc / 4)) + 0.20 * (greatest(0, least(1, amp / 0.3)) - greatest(0, least(1, del / 0.3))) - 0.20 * greatest(0, least(1, (beta - 0.5) / 0.5)) as t, det, residual, beta > 0.9 as gap from fx_genes)
    select gene, round(round(s * case when gap then t / 0.7 else t + 0.15 * greatest(-1, least(1, (det - 0.3) / 0.7)) + 0.15 * greatest(-1, least(1, residual / 2)) end, 4), 3) as score from p""")
def r12(v):
    none = F.lit(None).cast("double")
    rows = v("fx_genes").withColumn("gap", F.col("beta") > 0.9).withColumns({"det": F.when(F.col("gap"), none).otherwise(F.col("det")), "residual": F.when(F.col("gap"), none).otherwise(F.col("residual"))})
    return rows.select("gene", F.round(rk.direction_score(F.when(F.col("log2fc") > 0.2, "repress").otherwise("activate")), 3).alias("score"))


@register("r13_role_audit", """with s as (select 0.7 * greatest(-1, least(1, (amp - del) / 0.3)) - 0.3 * greatest(0, least(1, (beta - 0.5) / 0.5)) as x, substr(gene, 2)::int % 3 as k from fx_genes), i as (select k, case when x > 0.1 then 'repress' when x < -0.1 then 'activate' end as d from s)
    select case when k = 0 then 'no prediction' when d is null then 'inconclusive' when (k = 1 and d = 'repress') or (k = 2 and d = 'activate') then 'corroborated' else 'conflict' end as verdict, count(*) as n from i group by 1""")
def r13(v):
    k = F.substring("gene", 2, 9).cast("int") % 3
    roles = F.when(k == 1, F.array(F.lit("repress"))).when(k == 2, F.array(F.lit("activate"))).otherwise(F.array().cast("array<string>"))
    return rk.role_audit(v("fx_genes").withColumn("admissible", roles)).groupBy("verdict").agg(F.count("*").alias("n"))
