"""Evaluation and audit queries."""

from pyspark.sql import functions as F

from locusframe.operators import evaluate as ev
from locusframe.plans.catalog import register
from locusframe.plans.queries_windows import PROFILES, SPLIT, assays, profiles, records

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


@register("e1_align", """with a as (select * from fx_pred where example_id % 50 <> 1), b as (select example_id, target + case when example_id % 40 = 0 then 1 else 0 end as target, case when example_id % 30 = 0 then 'x' else grp end as grp, split from fx_pred where example_id % 60 <> 2)
    select example_id, r as reason from (select example_id, unnest(list_filter([case when b.target is null then 'only in b' end], lambda x: false)) as r from a left join b using (example_id)) union all
    select example_id, 'only in a' from a anti join b using (example_id) union all select example_id, 'only in b' from b anti join a using (example_id) union all select example_id, 'grp differs' from a join b using (example_id) where a.grp <> b.grp union all select example_id, 'target drifts' from a join b using (example_id) where abs(a.target - b.target) > 1e-6""")
def e1(v):
    p = v("fx_pred")
    b = p.where("example_id % 60 <> 2").withColumn("target", F.col("target") + F.when(F.col("example_id") % 40 == 0, 1).otherwise(0)).withColumn("grp", F.when(F.col("example_id") % 30 == 0, "x").otherwise(F.col("grp")))
    return ev.align(p.where("example_id % 50 <> 1"), b, "example_id", ["grp", "split"], "target")


@register("e2_merge_predictions", f"with {PROFILES} select vec_id::varchar as item, 'duplicate id' as reason from pf where vec_id % 4 = 0 union all select null, 'several identities'")
def e2(v):
    p = profiles(v).withColumn("model", F.lit("m1"))
    return ev.merge_predictions([p.where("vec_id % 2 = 0"), p.where("vec_id % 4 = 0").withColumn("model", F.lit("m2"))], "vec_id", "model", "target")[1]


@register("e3_contrast", f"with {PROFILES} select a.vec_id // 2 as k, list_transform(range(1, 65), lambda i: round(b.target[i] - a.target[i], 6)) as delta, case when a.label <> b.label then 'label' else '' end as drift from pf a join pf b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1")
def e3(v):
    p = profiles(v).withColumn("k", F.expr("vec_id div 2"))
    out = ev.contrast(p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1"), "k", "target", ["label"])
    return out.select("k", F.transform("delta", lambda x: F.round(x, 6)).alias("delta"), F.array_join("drift", ",").alias("drift"))


@register("e4_ensemble", f"with {PROFILES}, r as (select vec_id // 4 as k, vec_id % 4 as seed, target from pf), m as (select k, i, avg(target[i]) as m from r, (select unnest(range(1, 65)) as i) group by k, i), c as (select k, count(*) = 4 as complete from r group by k) select k, list(round(m, 6) order by i) as target, any_value(complete) as complete from m join c using (k) group by k")
def e4(v):
    p = profiles(v).withColumn("k", F.expr("vec_id div 4")).withColumn("seed", (F.col("vec_id") % 4).cast("int"))
    return ev.ensemble(p, "k", "seed", "target", [0, 1, 2, 3]).select("k", F.transform("target", lambda x: F.round(x, 6)).alias("target"), "complete")


RADIUS = "w as (select grp, max(abs(target - pred_a)) as e from fx_pred where split = 'F' group by grp), o as (select e, row_number() over (order by e) as r, count(*) over () as n from w), q as (select e as radius from o where r = least(ceil((n + 1) * 0.8), n))"


def conformal(v):
    p = v("fx_pred").withColumn("mask", F.lit(True))
    return ev.group_conformal(p.where("split = 'F'").withColumn("prediction", F.col("pred_a")), p.withColumn("prediction", F.col("pred_b")), 0.8)


@register("e5_group_conformal", f"with {RADIUS} select example_id, round(greatest(pred_b - radius, 0), 4) as lower, round(pred_b + radius, 4) as upper from fx_pred, q")
def e5(v):
    return conformal(v).select("example_id", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@register("e6_interval_calibration", f"""with {RADIUS}, i as (select grp, target, greatest(pred_b - radius, 0) as lower, pred_b + radius as upper from fx_pred, q), c as (select grp, avg((target between lower and upper)::int) as c from i group by grp)
    select (select round(avg(c), 6) from c) as coverage, (select count(*) from c) as groups, round(avg(upper - lower), 4) as width, round(quantile_cont(target, 0.75) - quantile_cont(target, 0.25), 4) as iqr from i""")
def e6(v):
    return ev.interval_calibration(conformal(v)).select(F.round("coverage", 6).alias("coverage"), "groups", F.round("width", 4).alias("width"), F.round("iqr", 4).alias("iqr"))


@register("e7_compare_models", "with s as (select grp, corr(target, pred_a) - corr(target, pred_b) as d from fx_pred group by grp having count(*) > 1) select round(avg(d), 6) as delta, count(*) as groups from s")
def e7(v):
    return ev.compare_models(v("fx_pred"), "pearson", "target", "pred_a", "pred_b", "grp", 200).select(*R("delta"), "groups")


@register("e9_check_groups", "with h as (select distinct grp from fx_pred), w as (select cast(n_nationkey + 3 as varchar) as grp from nation) select grp, 'unexpected' as reason from h anti join w using (grp) union all select grp, 'missing' from w anti join h using (grp)")
def e9(v):
    return ev.check_groups(v("fx_pred"), v("nation").select((F.col("n_nationkey") + 3).cast("string").alias("grp")))


HELD = ["external_study_test", "temporal_test", "joint_locus_state_test", "state_test", "locus_test"]


@register("e10_leakage_audit", f"""with {SPLIT}, s as (select *, case when split = 'train' then 1 when split in ({', '.join(repr(h) for h in HELD)}) then 2 end as side from sp), k as (select * from s where side is not null)
    select 'groups' as kind, (select count(*) from (select 1 from k group by sample_group having min(side) <> max(side))) as n union all select 'intervals', (select count(*) from (select 1 from k group by chrom, start_pos, end_pos having min(side) <> max(side))) union all
    select 'studies', (select count(*) from (select 1 from k group by study having min(side) <> max(side))) union all select 'duplicate ids', 0 union all select 'unknown splits', 0""")
def e10(v):
    return ev.leakage_audit(records(v), "example_id", "train", HELD, ["train", "validation", *HELD])


@register("e10_split_counts", f"with {SPLIT} select split, count(*) as n, count(distinct sample_group) as groups from sp group by split")
def e10_counts(v):
    return ev.split_counts(records(v))


@register("e11_scope_audit", f"with {SPLIT}, g as (select study, list(distinct split order by split) as splits from sp group by study), w as (select unnest(['click', 'refund', 'absent']) as study) select study, array_to_string(splits, ',') as splits, coalesce(splits = ['external_study_test'], false) as ok from w left join g using (study)")
def e11(v):
    return ev.scope_audit(records(v), ["click", "refund", "absent"], "external_study_test").select("study", F.array_join("splits", ",").alias("splits"), "ok")


@register("e12_stability_audit")
def e12(v):
    p = v("embeddings").select((F.col("vec_id") % 3).alias("seed"), F.expr("vec_id div 3").alias("example"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("factors"))
    return ev.stability_audit(p, "seed", "example", "factors")


@register("e13_profile_metrics", f"""with {PROFILES}, e as (select vec_id, i, target[i] as t, target[i] * 0.9 + 0.01 as p, valid[i] as m from pf, (select unnest(range(1, 65)) as i)), b as (select vec_id, (i - 1) // 4 as b, avg(t - p) as d, bool_and(m) as m from e group by vec_id, b),
    q as (select vec_id, avg(d * d) filter (m) as mse_4 from b group by vec_id) select e.vec_id, round(avg((t - p) * (t - p)) filter (m), 9) as mse_1, round(any_value(mse_4), 9) as mse_4, round(corr(t, p) filter (m), 6) as r from e join q using (vec_id) group by e.vec_id""")
def e13(v):
    p = profiles(v).withColumn("pred", F.transform("target", lambda x: x * 0.9 + 0.01))
    return ev.profile_metrics(p, "vec_id", "target", "pred", "valid", (1, 4)).select("vec_id", F.round("mse_1", 9).alias("mse_1"), F.round("mse_4", 9).alias("mse_4"), *R("r"))


@register("e14_verify_provenance", """select o_orderkey as name, case when o_orderkey % 13 = 0 then 'unknown status' when o_orderkey % 4 = 1 then null when o_orderkey % 6 = 0 then 'not materialised' when o_orderkey % 10 = 0 then 'tampered' when o_orderkey % 14 = 0 then 'size differs' end as reason from orders""")
def e14(v):
    k = F.col("o_orderkey")
    status = F.when(k % 13 == 0, "odd").when(k % 4 == 1, "pointer").otherwise("materialized")
    rows = v("orders").select(k.alias("name"), status.alias("status"), F.sha2(k.cast("string"), 256).alias("sha256"), (k % 1000).alias("bytes"), k.alias("path"))
    files = v("orders").where(k % 6 != 0).select(k.alias("path"), F.sha2(F.when(k % 10 == 0, F.lit("x")).otherwise(k.cast("string")), 256).alias("sha256"), (k % 1000 + F.when(k % 14 == 0, 1).otherwise(0)).alias("bytes"))
    return ev.verify_provenance(rows, files)


@register("e15_inventory", "select o_orderpriority as corpus, count(*) as artifacts, sum(o_custkey)::bigint as bytes, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O from orders group by o_orderpriority")
def e15(v):
    rows = v("orders").select(F.col("o_orderpriority").alias("corpus"), F.col("o_custkey").alias("bytes"), F.col("o_orderstatus").alias("status"))
    return ev.inventory(rows, ["corpus"], ["F", "O"])


@register("e16_reduce_data_class", "with c as (select o_custkey, (['REAL', 'DERIVED', 'POINTER', 'SYNTHETIC', 'PLACEHOLDER'])[o_orderkey % 5 + 1] as d, o_orderkey % 5 as k from orders where o_orderkey % 5 < 1 + o_custkey % 5) select o_custkey, arg_max(d, k) as data_class from c group by o_custkey")
def e16(v):
    k = F.col("o_orderkey") % 5
    rows = v("orders").where(k < 1 + F.col("o_custkey") % 5).withColumn("data_class", F.element_at(F.array(*[F.lit(x) for x in ev.DATA_CLASSES]), (k + 1).cast("int")))
    return ev.reduce_data_class(rows, ["o_custkey"])


@register("e16_guard_text", "select p_partkey, concat_ws(',', case when regexp_matches(p_name, 'a[0-9]|e ') then 'p_name' end, case when regexp_matches(p_type, 'a[0-9]|e ') then 'p_type' end) as blocked from part")
def e16_guard(v):
    return ev.guard_text(v("part"), ["p_name", "p_type"], ["a[0-9]", "e "]).select("p_partkey", F.array_join("blocked", ",").alias("blocked"))


@register("e17_verify_compiled", """with s as (select c_custkey as k, c_nationkey as n, c_mktsegment as m from customer where c_custkey % 40 <> 3), t as (select c_custkey as k, c_nationkey + case when c_custkey % 25 = 0 then 1 else 0 end as n, c_mktsegment as m from customer where c_custkey % 30 <> 4)
    select k, 'n differs' as failures from s join t using (k) where s.n <> t.n union all select k, 'no manifest' from s anti join t using (k) union all select k, 'no spec' from t anti join s using (k)""")
def e17(v):
    s = v("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"))
    t = s.where("k % 30 <> 4").withColumn("n", F.col("n") + F.when(F.col("k") % 25 == 0, 1).otherwise(0))
    return ev.verify_compiled(s.where("k % 40 <> 3"), t, "k", ["n", "m"]).select("k", F.array_join("failures", ",").alias("failures"))


@register("e19_regex_target_map", """with r as (select * from (values ('a', 'BRASS', 1, 100000), ('b', '^STANDARD', 1, 10), ('c', 'zzz', 0, 0)) v(rule, pattern, least_n, most_n)) select rule, count(p_partkey) as n, count(p_partkey) between least_n and most_n as ok, coalesce(min(p_partkey), -1) as first from r left join part on regexp_matches(p_type, pattern) group by rule, least_n, most_n""")
def e19(v):
    desc = v("part").select(F.col("p_partkey").alias("index"), F.col("p_type").alias("description"))
    rules = desc.sparkSession.createDataFrame([("a", "BRASS", 1, 100000), ("b", "^STANDARD", 1, 10), ("c", "zzz", 0, 0)], "rule string, pattern string, least int, most int")
    return ev.regex_target_map(desc, rules).select("rule", "n", "ok", F.coalesce(F.array_min("targets"), F.lit(-1)).cast("long").alias("first"))


@register("a_assay_inventory", """select assay, count(*) as artifacts, sum(accession)::bigint as bytes, count(*) filter (status = 'released') as released from (select c_custkey as accession, (['ATAC-seq', 'Histone ChIP-seq', 'total RNA-seq', 'RAMPAGE', 'WGBS', 'TF ChIP-seq'])[c_custkey % 6 + 1] as assay, (['released', 'archived'])[(c_custkey // 5) % 2 + 1] as status from customer) group by assay""")
def assay_inventory(v):
    return ev.inventory(assays(v).withColumn("bytes", F.col("accession")), ["assay"], ["released"])
