"""Window compilation, split, pairing, metadata and network queries."""

from pyspark.sql import functions as F

from locusframe.operators import decode as dc
from locusframe.operators import graph as gr
from locusframe.operators import windows as wd
from locusframe.plans.catalog import register

R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
SIZES = "sz as (select chrom, max(end_pos) as size from fx_peaks group by chrom)"
TILES = f"{SIZES}, tl as (select chrom, start_pos, start_pos + 2048 as end_pos, chrom || chr(58) || start_pos as w from (select chrom, unnest(generate_series(0, size - 2048, 2048)) as start_pos from sz where size >= 2048))"


def sizes(v):
    return v("fx_peaks").groupBy("chrom").agg(F.max("end_pos").alias("size"))


def tiles(v):
    return wd.tile(sizes(v), 2048).withColumn("w", F.concat_ws(":", "chrom", "start_pos"))


@register("w1_tile", f"with {TILES}, h as (select chrom, unnest(generate_series(0, size - 2048, 1024)) as start_pos from sz) select chrom, start_pos, start_pos + 2048 as end_pos from h")
def w1(v):
    return wd.tile(sizes(v), 2048, 1024)


@register("w2_sample_windows", f"with {TILES} select w from tl order by sha256('11' || chr(58) || w), w limit 300")
def w2(v):
    return wd.sample_windows(tiles(v), 300, 11, "w").select("w")


@register("w3_bin_signal", f"""with {TILES}, p as (select w, greatest(a.start_pos, b.start_pos) - a.start_pos as lo, least(a.end_pos, b.end_pos) - a.start_pos as hi, b.value as v from tl a join fx_track b on a.chrom = b.chrom and a.start_pos < b.end_pos and a.end_pos > b.start_pos),
    c as (select w, b, least(hi, (b + 1) * 256) - greatest(lo, b * 256) as n, v from (select *, unnest(generate_series(lo // 256, (hi - 1) // 256)) as b from p)), m as (select w, b, sum(n * v) / sum(n) as m from c group by w, b), g as (select w, b from tl, (select unnest(range(8)) as b))
    select g.w, list(round(coalesce(m, 0)::float::double, 1) order by g.b) as target, list(m is not null order by g.b) as valid from g left join m on g.w = m.w and g.b = m.b group by g.w""")
def w3(v):
    return wd.bin_signal(v("fx_track"), tiles(v), "w", 256).select("w", F.transform("target", lambda x: F.round(x.cast("double"), 1)).alias("target"), "valid")


PROFILES = "pf as (select vec_id, list_transform(embedding, lambda x: abs(x)::double) as target, list_transform(embedding, lambda x: x > -0.1) as valid, label from embeddings)"


def profiles(v):
    return v("embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("target"), F.transform("embedding", lambda x: x > -0.1).alias("valid"), "label")


@register("w4_filter_windows", f"""with {PROFILES}, m as (select vec_id, list_avg(list_transform(list_filter(generate_series(1, len(target)), lambda i: valid[i]), lambda i: target[i])) as m, list_contains(valid, true) as has from pf)
    select vec_id from m where has and (m > 0.08 or ('0x' || substr(sha256('4' || chr(58) || vec_id), 1, 12))::bigint / 281474976710656.0 < 0.3)""")
def w4(v):
    return wd.filter_windows(profiles(v), "vec_id", 0.08, 0.3, 4).select("vec_id")


POLICY = wd.SplitPolicy(held_out_groups=("grp3", "grp7"), external_studies=("refund",), cutoff="2024-06-01")
SPLIT = """sp as (select *, case when study = 'refund' then 'external_study_test' when released <> '' and released > '2024-06-01' then 'temporal_test' when sample_group in ('grp3', 'grp7') and chrom in ('chr8', 'chr9') then 'joint_locus_state_test'
    when sample_group in ('grp3', 'grp7') then 'state_test' when chrom in ('chr8', 'chr9') then 'locus_test' when chrom in ('chr6', 'chr7') then 'validation' else 'train' end as split from fx_records)"""


def records(v):
    return wd.assign_split(v("fx_records"), POLICY)


@register("w5_assign_split", f"with {SPLIT} select example_id, split from sp")
def w5(v):
    return records(v).select("example_id", "split")


@register("w5_split_by_role", "select example_id, case study when 'click' then 'validation' when 'view' then case when chrom in ('chr8', 'chr9') then 'joint_locus_state_test' else 'state_test' end else case when chrom in ('chr6', 'chr7') then 'validation' when chrom in ('chr8', 'chr9') then 'locus_test' else 'train' end end as split from fx_records")
def w5_role(v):
    role = F.when(F.col("study") == "click", "validation_study").when(F.col("study") == "view", "held_out_state").otherwise("development")
    return wd.split_by_role(v("fx_records").withColumn("split_role", role)).select("example_id", "split")


@register("w6_chrom_split", "select example_id, case when chrom in ('chr8', 'chr9') then 'test' when chrom in ('chr6', 'chr7') then 'val' else 'train' end as split from fx_records")
def w6(v):
    return wd.chrom_split(v("fx_records"), ["chr6", "chr7"], ["chr8", "chr9"]).select("example_id", "split")


@register("w6_group_split", """with g as (select sample_group, row_number() over (order by sha256('2' || chr(58) || sample_group), sample_group) as r, count(*) over () as n from (select distinct sample_group from fx_records))
    select example_id, case when r <= round(n * 0.2) then 'test' when r <= round(n * 0.2) + round(n * 0.1) then 'val' else 'train' end as split from fx_records join g using (sample_group)""")
def w6_group(v):
    return wd.group_split(v("fx_records"), "sample_group", 0.1, 0.2, 2).select("example_id", "split")


@register("w6_hash_split", """with u as (select example_id, ('0x' || substr(sha256('salt' || chr(58) || example_id), 1, 12))::bigint / 281474976710656.0 as u from fx_records) select example_id, case when u < 0.1 then 'test' when u < 0.3 then 'val' else 'train' end as split from u""")
def w6_hash(v):
    return wd.hash_split(v("fx_records"), "example_id", "salt", 0.2, 0.1).select("example_id", "split")


@register("w7_scan_windows", f"with {SPLIT} select example_id, study, split from sp where study in ('click', 'view') and split in ('train', 'locus_test') and example_id % 3 = 0")
def w7(v):
    rows = records(v)
    return wd.scan_windows(rows, include=("click", "view"), splits=("train", "locus_test"), ids=rows.where("example_id % 3 = 0")).select("example_id", "study", "split")


@register("w7_forbidden_splits", f"with {SPLIT} select study, split, count(*) as count from sp where study in ('click') and split <> 'validation' group by study, split")
def w7_forbidden(v):
    return wd.forbidden_splits(records(v), ["click"])


@register("w8_pad_zero_vector", "select vec_id, case when vec_id % 2 = 0 then list_transform(range(70), lambda i: 0.0::double) else list_transform(list_concat(embedding, [1, 1, 1, 1, 1, 1]), lambda x: round(x::double, 6)) end as x from embeddings")
def w8(v):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = v("embeddings").withColumn("x", F.when(F.col("vec_id") % 2 == 0, F.transform(e, lambda x: F.lit(0.0))).otherwise(F.concat(e, F.array_repeat(F.lit(1.0), 6))))
    # round() drops the sign of what it makes zero; the SQL keeps it.
    signed = lambda x: F.when(F.round(x, 6) == 0, x * 0.0).otherwise(F.round(x, 6))
    return rows.select("vec_id", F.transform(wd.pad_zero_vector("x", 70), signed).alias("x"))


@register("w9_retile", f"with {PROFILES} select vec_id || chr(58) || t as example_id, vec_id as parent, t::int as tile, vec_id * 64 + t * 16 as start_pos, list_transform(target[t * 16 + 1 : t * 16 + 16], lambda x: round(x, 6)) as target from pf, (select unnest(range(4)) as t)")
def w9(v):
    rows = profiles(v).withColumn("start_pos", F.col("vec_id") * 64).withColumn("end_pos", F.col("start_pos") + 64).withColumnRenamed("vec_id", "example_id").drop("label")
    out = wd.retile(rows, 16, 1, ["target", "valid"])
    return out.select("example_id", "parent", "tile", "start_pos", F.transform("target", lambda x: F.round(x, 6)).alias("target"))


PAIRS = f"""{PROFILES}, rf as (select vec_id // 2 as k, target, valid from pf where vec_id % 2 = 0 and vec_id % 10 <> 4), tr as (select vec_id // 2 as k, target, valid from pf where vec_id % 2 = 1 and vec_id % 14 <> 3),
    pw as (select k, case when rf.target is null then 'treatment_only' when tr.target is null then 'reference_only' else 'matched' end as side, case when rf.target is not null and tr.target is not null then list_transform(range(1, 65), lambda i: round(tr.target[i] - rf.target[i], 6)) end as delta from rf full join tr using (k))"""


def paired(v):
    p = profiles(v).withColumn("k", F.expr("vec_id div 2"))
    return wd.pair_windows(p.where("vec_id % 2 = 0 and vec_id % 10 <> 4"), p.where("vec_id % 2 = 1 and vec_id % 14 <> 3"), ["k"])


@register("w10_pair_windows", f"with {PAIRS} select k, side, delta from pw")
def w10(v):
    return paired(v).select("k", "side", F.transform("delta", lambda x: F.round(x, 6)).alias("delta"))


@register("w10_pair_gate", f"with {PAIRS}, c as (select count(*) filter (side = 'matched') as matched, count(*) filter (side = 'reference_only') as reference_only, count(*) filter (side = 'treatment_only') as treatment_only from pw) select *, round(matched / (matched + least(reference_only, treatment_only))::double, 6) as overlap, matched / (matched + least(reference_only, treatment_only))::double >= 0.8 as passes from c")
def w10_gate(v):
    return wd.pair_gate(paired(v), 0.8).withColumn("overlap", F.round("overlap", 6))


@register("w11_check_pairs", """select pair_id, reason from (select o_orderkey as pair_id, unnest(list_filter([case when o_orderkey % 5 = 0 then 'genome differs' end, case when o_custkey % 7 = 0 then 'no pair group' end, case when o_orderkey % 11 = 0 then 'lengths differ' end], lambda x: x is not null)) as reason from orders)""")
def w11(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = v("orders").select(
        k.alias("pair_id"), F.lit("hg38").alias("ref_genome"), F.when(k % 5 == 0, "hg19").otherwise("hg38").alias("trt_genome"), F.when(c % 7 == 0, "").otherwise("g").alias("ref_pair_group"), F.when(c % 7 == 0, "").otherwise("g").alias("trt_pair_group"),
        F.lit("control").alias("ref_relation"), F.lit("intervention").alias("trt_relation"), F.lit(8).alias("ref_bins"), F.when(k % 11 == 0, 4).otherwise(8).alias("trt_bins"))
    return wd.check_pairs(rows)


TRACKS = "tk as (select o_orderkey as accession, 'p' || (o_custkey % 900) as pair_group, case when o_orderkey % 5 = 0 then 'control' else 'intervention' end as pair_relation, case when o_orderkey % 50 = 7 then 'mm10' else 'hg38' end as genome, 'ATAC' as assay from orders)"


def tracks(v):
    k = F.col("o_orderkey")
    return v("orders").select(k.alias("accession"), F.concat(F.lit("p"), (F.col("o_custkey") % 900).cast("string")).alias("pair_group"), F.when(k % 5 == 0, "control").otherwise("intervention").alias("pair_relation"), F.when(k % 50 == 7, "mm10").otherwise("hg38").alias("genome"), F.lit("ATAC").alias("assay"))


@register("w12_pair_plan", f"""with {TRACKS}, g as (select pair_group, count(*) filter (pair_relation = 'control') as c, count(*) filter (pair_relation = 'intervention') as i, min(accession) filter (pair_relation = 'control') as control, arg_min(genome, accession) filter (pair_relation = 'control') as cg from tk group by pair_group),
    r as (select pair_group, accession, control, case when c = 0 then 'no control' when c > 1 then 'several controls' when genome <> cg then 'genome differs' end as reason from tk join g using (pair_group) where pair_relation = 'intervention' union all select pair_group, accession, null, 'no intervention' from tk join g using (pair_group) where pair_relation = 'control' and i = 0)
    select *, case when reason is null then 'paired' else 'unresolved' end as status from r""")
def w12(v):
    return wd.pair_plan(tracks(v))


@register("w13_replicate_gate", """with n as (select pair_group as grp, genome as assay, count(*) as n from tk group by all), g as (select 'p' || unnest(range(1000)) as grp, 'hg38' as assay) select grp, assay, coalesce(n, 0) as n, case when g.grp is null then 'not registered' else 'too few replicates' end as reason
    from (select *, 1 as gg from g) g full join n using (grp, assay) where gg is null or coalesce(n, 0) < 14""".replace("with n", f"with {TRACKS}, n").replace("g.grp is null", "gg is null"))
def w13(v):
    rows = tracks(v).select(F.col("pair_group").alias("grp"), F.col("genome").alias("assay"))
    want = rows.sparkSession.range(1000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("grp"), F.lit("hg38").alias("assay"))
    return wd.replicate_gate(rows, want, 14)


@register("w14_recenter", f"with {TILES} select w, start_pos - 1024 as start_pos, end_pos + 1024 as end_pos, start_pos - 1024 < 0 or end_pos + 1024 > size as dropped from tl join sz using (chrom)")
def w14(v):
    return wd.recenter(tiles(v), 4096, sizes(v)).select("w", "start_pos", "end_pos", "dropped")


@register("w15_hash_topn", "select example_id, study, chrom from fx_records qualify row_number() over (partition by study, chrom order by sha256('9' || chr(58) || example_id), example_id) <= 5")
def w15(v):
    return wd.hash_topn_per_stratum(v("fx_records"), ["study", "chrom"], 5, 9, "example_id").select("example_id", "study", "chrom")


@register("w16_center_crop", f"with {PROFILES} select vec_id, list_transform(target[23:42], lambda x: round(x, 6)) as target from pf")
def w16(v):
    return profiles(v).select("vec_id", F.transform(wd.center_crop("target", 20), lambda x: F.round(x, 6)).alias("target"))


@register("w17_freeze_truth", f"with {PROFILES} select vec_id, list_transform(target, lambda x: round(x, 6)) as target from pf where vec_id % 3 = 0")
def w17(v):
    p = profiles(v)
    return wd.freeze_truth(p, p.where("vec_id % 3 = 0"), "target", "valid", "vec_id").select("vec_id", F.transform("target", lambda x: F.round(x, 6)).alias("target"))


@register("w17_truth_violations", "with d as (select o_custkey as c, count(*) as n from orders group by o_custkey) select c_custkey as c, case when n is null then 'missing' else 'duplicate' end as reason from customer left join d on c = c_custkey where n is null or n > 1")
def w17_violations(v):
    return wd.truth_violations(v("orders").select(F.col("o_custkey").alias("c")), v("customer").select(F.col("c_custkey").alias("c")), "c")


@register("w18_quality_filter", "select vec_id from embeddings where embedding[64] >= 0.05")
def w18(v):
    return wd.quality_filter(v("embeddings"), "embedding", 0.05).select("vec_id")


@register("n1_coexpression_edges", """with p as (select a.gene as src, b.gene as dst, corr(a.value, b.value) as r from fx_matrix a join fx_matrix b on a.sample = b.sample and a.gene <> b.gene group by a.gene, b.gene) select src, dst, round(abs(r), 6) as weight, sign(r)::int as sign from p where abs(r) > 0.3""")
def n1(v):
    return gr.coexpression_edges(v("fx_matrix"), 0.3).select("src", "dst", *R("weight"), "sign")


@register("n2_degrees", """with o as (select src as node, count(*) as out_degree, sum(weight) as out_strength, count(*) filter (weight > 5) as over from fx_edges group by src), i as (select dst as node, count(*) as in_degree, sum(weight) as in_strength from fx_edges group by dst)
    select node, coalesce(out_degree, 0) as out_degree, coalesce(out_strength, 0) as out_strength, coalesce(over, 0) as over, coalesce(in_degree, 0) as in_degree, coalesce(in_strength, 0) as in_strength from o full join i using (node)""".replace("over from", '"over" from').replace("as over,", 'as "over",').replace("coalesce(over", 'coalesce("over"'))
def n2(v):
    return gr.degrees(v("fx_edges"), 5)


@register("n3_pagerank", """with recursive sh as (select src, dst, weight / sum(weight) over (partition by src) as s from fx_edges), nd as (select distinct node from (select src as node from fx_edges union all select dst from fx_edges)), cn as (select count(*) as n from nd),
    pr as (select 0 as t, node, 1.0::double / (select n from cn) as r from nd union all select t + 1, node, 0.15::double / (select n from cn) + 0.85::double * coalesce((select sum(s * r) from sh join pr q on q.node = sh.src where sh.dst = nd.node), 0) + 0.85::double * coalesce((select sum(q.r) from pr q where q.node not in (select src from fx_edges)), 0) / (select n from cn) from nd, (select max(t) as t from pr) where t < 40)
    select node, round(r, 6) as rank from pr where t = 40""")
def n3(v):
    return gr.pagerank(v("fx_edges")).select("node", *R("rank"))


#: Hubs are the power iteration of edges times their turned edges; each round is scaled by the mean entry.
@register("n4_hits", """with recursive nd as (select distinct node from (select src as node from fx_edges union all select dst from fx_edges)), m as (select a.src, b.src as dst, sum(a.weight * b.weight) as w from fx_edges a join fx_edges b on a.dst = b.dst group by a.src, b.src), sc as (select sum(w) / (select count(*) from nd) as s from m),
    h as (select 0 as t, node, 1.0::double as x from nd union all select t + 1, node, coalesce((select sum(w * x) from m join h q on q.node = m.dst where m.src = nd.node), 0) / (select s from sc) from nd, (select max(t) as t from h) where t < 60),
    l as (select node, x / sqrt(sum(x * x) over ()) as hub from h where t = 60), a as (select dst as node, sum(weight * hub) as a from fx_edges join l on l.node = src group by dst)
    select node, round(hub, 6) as hub, round(coalesce(a, 0) / sqrt(sum(a * a) over ()), 6) as authority from l left join a using (node)""")
def n4(v):
    return gr.hits(v("fx_edges")).select("node", *R("hub", "authority"))


@register("n4_hub_proxy", "with s as (select dst as node, sum(weight) as s from fx_edges group by dst) select src as node, sum(weight * s) as hub from fx_edges join s on s.node = dst group by src")
def n4_proxy(v):
    return gr.hub_proxy(v("fx_edges"))


@register("n5_eigencentrality", """with recursive nd as (select distinct node from (select src as node from fx_edges union all select dst from fx_edges)), sc as (select count(*)::double / (select count(*) from nd) as s from fx_edges),
    c as (select 0 as t, node, 1.0::double as x from nd union all select t + 1, node, coalesce((select sum(x) from fx_edges e join c q on q.node = e.dst where e.src = nd.node), 0) / (select s from sc) from nd, (select max(t) as t from c) where t < 100)
    select node, round(x / sqrt(sum(x * x) over ()), 6) as centrality from c where t = 100""")
def n5(v):
    return gr.eigencentrality(v("fx_edges")).select("node", *R("centrality"))


@register("n6_centrality_composite", """with d as (select node, coalesce(o.d, 0) as a, coalesce(i.d, 0) as b from (select src as node, sum(weight) as d from fx_edges group by src) o full join (select dst as node, count(*) as d from fx_edges group by dst) i using (node))
    select node, round(((a - avg(a) over ()) / stddev_pop(a) over () + case when stddev_pop(b) over () > 0 then (b - avg(b) over ()) / stddev_pop(b) over () else 0 end) / 2, 6) as centrality from d""")
def n6(v):
    return gr.centrality_composite(gr.degrees(v("fx_edges")), ["out_strength", "in_degree"]).select("node", *R("centrality"))


@register("n7_motif_supported_edges", "select src, dst, weight, case when (src + dst) % 3 = 0 then round(weight / 10, 6) else 0 end as support from fx_edges")
def n7(v):
    e = v("fx_edges")
    motifs = e.where("(src + dst) % 3 = 0").select("src", "dst", (F.col("weight") / 10).alias("score"))
    return gr.motif_supported_edges(e, motifs).select("src", "dst", "weight", *R("support"))


@register("n7_motif_targets_up", "select src, count(*) as n from fx_edges join fx_genes on gene = 'G' || dst where log2fc > 0 group by src")
def n7_targets(v):
    motifs = v("fx_edges").select("src", F.concat(F.lit("G"), F.col("dst").cast("string")).alias("dst"), F.col("weight").alias("score"))
    return gr.motif_targets_up(motifs, v("fx_genes"))


def samples(v):
    k = F.col("c_custkey")
    cell = F.when(k % 6 == 0, "Normal pancreatic  organoid").when(k % 6 == 1, "PanIN organoid").when(k % 6 == 2, "primary tumor organoid").when(k % 6 == 3, "liver metastasis").otherwise("other")
    traits = F.create_map(F.lit("cell type"), F.when(k % 17 == 0, F.array(cell, F.lit("second"))).otherwise(F.array(cell)), F.lit("peturbation"), F.when(k % 4 == 0, F.array(F.lit(" drug "))).otherwise(F.array().cast("array<string>")))
    return v("customer").select(k.alias("sample"), F.when(k % 3 == 0, "Mus musculus").otherwise("Homo  sapiens").alias("organism"), traits.alias("characteristics"), F.array(F.when(k % 3 == 0, "aligned to mm10").when(k % 5 == 0, "hg19 and hg38").otherwise("mapped to hg38.")).alias("processing"))


@register("d1_decode_samples", """select c_custkey as sample, case when c_custkey % 3 = 0 then 'mouse' else 'human' end as species, case when c_custkey % 3 = 0 then 'mm10' when c_custkey % 5 = 0 then null else 'hg38' end as genome,
    case c_custkey % 6 when 0 then 'healthy_pancreas' when 1 then 'PanIN' when 2 then 'primary_PDAC' when 3 then 'metastatic_PDAC' end as state, case when c_custkey % 4 = 0 then 'drug' else 'none' end as perturbation,
    concat_ws(';', case when c_custkey % 3 <> 0 and c_custkey % 5 = 0 then 'ambiguous genome' end, case when c_custkey % 17 = 0 then 'conflicting cell type' end, case when c_custkey % 17 <> 0 and c_custkey % 6 > 3 then 'unmapped cell type' end) as errors from customer""")
def d1(v):
    return dc.decode_samples(samples(v)).select("sample", "species", "genome", "state", "perturbation", F.array_join("errors", ";").alias("errors"))


def assays(v):
    k = F.col("c_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(k / n) % len(xs) + 1).cast("int"))
    return v("customer").select(k.alias("accession"), pick(1, "ATAC-seq", "Histone ChIP-seq", "total RNA-seq", "RAMPAGE", "WGBS", "TF ChIP-seq").alias("assay"), pick(2, "H3K27ac", "CTCF", "H3K4me3", "").alias("target"), pick(3, "plus strand", "minus strand", "signal", "fold change").alias("output_type"), pick(5, "released", "archived").alias("status"), (k % 9 == 0).alias("audit"))


AS = """a as (select c_custkey as accession, (['ATAC-seq', 'Histone ChIP-seq', 'total RNA-seq', 'RAMPAGE', 'WGBS', 'TF ChIP-seq'])[c_custkey % 6 + 1] as assay, (['H3K27ac', 'CTCF', 'H3K4me3', ''])[(c_custkey // 2) % 4 + 1] as target,
    (['plus strand', 'minus strand', 'signal', 'fold change'])[(c_custkey // 3) % 4 + 1] as output_type, (['released', 'archived'])[(c_custkey // 5) % 2 + 1] as status, c_custkey % 9 = 0 as audit from customer)"""


@register("d2_assay_vector", f"""with {AS}, f as (select *, instr(assay, 'RNA') > 0 as rna, assay = 'RAMPAGE' as cap, instr(output_type, 'minus') > 0 as mi, instr(output_type, 'plus') > 0 as pl from a)
    select accession, [(assay = 'ATAC-seq')::int::double, (target = 'H3K27ac')::int, 0, (target = 'H3K4me3')::int, 0, 0, (assay = 'TF ChIP-seq' or target = 'CTCF')::int, case when (rna or cap) and pl then 1 when rna and not mi then 0.5 else 0 end, case when (rna or cap) and mi then 1 when rna and not pl then 0.5 else 0 end,
    cap::int, (assay = 'WGBS')::int, case when status = 'released' and not audit then 1 else 0.5 end] as x from f""")
def d2(v):
    return assays(v).select("accession", dc.assay_vector("assay", "target", "output_type", "status", "audit").alias("x"))


@register("d3_selection_reason", f"""with {AS} select accession, case when status <> 'released' then 'status is ' || status || ', not released' when assay = 'WGBS' then 'coverage is not a methylation state' when assay not in ('ATAC-seq', 'Histone ChIP-seq') then 'assay without condition semantics: ' || assay
    when output_type not in ('fold change', 'signal') then 'noncanonical output' when assay = 'Histone ChIP-seq' and target not in ('H3K27ac', 'H3K4me3') then 'unsupported histone target' end as reason from a""")
def d3(v):
    return dc.selection_reason(assays(v), {"ATAC-seq": ["fold change", "signal"], "Histone ChIP-seq": ["fold change", "signal"]}, ["H3K27ac", "H3K4me3"]).select("accession", "reason")


@register("d4_track_specs", f"""with {AS}, s as (select c_custkey as sample, case when c_custkey % 3 = 0 then 'mouse' else 'human' end as species, case when c_custkey % 3 = 0 then 'mm10' else 'hg38' end as genome from customer where not (c_custkey % 3 <> 0 and c_custkey % 5 = 0) and c_custkey % 17 <> 0 and c_custkey % 6 <= 3)
    select a.accession, s.sample, species || '|' || genome || '|' || assay as pair_group, case when s.sample % 10 = 1 then 'external_study' else 'train' end as split_role, assay as kept from a join s on s.sample = a.accession""")
def d4(v):
    files = assays(v).withColumn("sample", F.col("accession")).withColumn("study", F.concat(F.lit("st"), (F.col("accession") % 10).cast("string")))
    files = files.withColumn("metadata", F.create_map(F.lit("assay"), F.col("assay"), F.lit("donor"), F.lit("private")))
    out = dc.track_specs(files, dc.decode_samples(samples(v)), ["st1"], ["donor"])
    return out.select("accession", "sample", "pair_group", "split_role", F.array_join(F.map_values("metadata"), ",").alias("kept"))
