"""Views over the driver's tables with the shapes that the operators take. One text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_peaks": """select event_id as peak_id, concat('chr', cast(user_id % 22 + 1 as string)) as chrom,
        (event_id*7919) % 1000000 as start_pos, (event_id*7919) % 1000000 + 100 + event_id % 400 as end_pos,
        event_type as name, value as signal from {events}""",
    "fx_loci": """select p_partkey as locus_id, concat('G', cast(p_partkey as string)) as symbol,
        concat('chr', cast(p_partkey % 22 + 1 as string)) as chrom, 1000 + (p_partkey*104729) % 1000000 as tss,
        case when p_size % 2 = 0 then '+' else '-' end as strand from {part}""",
    "fx_windows2k": """select locus_id, symbol, chrom, tss, strand, tss - 1000 as start_pos, tss + 1000 as end_pos from {fx_loci}""",
    "fx_track": """select concat('chr', cast(l_partkey % 22 + 1 as string)) as chrom, (l_orderkey*613 + l_linenumber*37) % 1000000 as start_pos,
        (l_orderkey*613 + l_linenumber*37) % 1000000 + cast(l_quantity as bigint) as end_pos,
        l_extendedprice as value, l_linestatus as side from {lineitem}""",
    "fx_expr": """select concat('G', cast(l_partkey % 200 as string)) as gene, concat('S', cast(l_suppkey % 40 as string)) as sample, l_quantity as value from {lineitem}""",
    "fx_matrix": """select gene, sample, avg(value) as value from {fx_expr} group by gene, sample""",
    "fx_labels": """select d.doc_id as id, d.lang as grp, cast(l.quality as int) as label, cast(l.toxic as int) as toxic, cast(d.n_chars as double) as score
        from {labels} l join {documents} d on l.doc_id = d.doc_id""",
    "fx_pred": """select o.o_orderkey as example_id, o.o_totalprice as target, o.o_totalprice + c.c_acctbal as pred_a, o.o_totalprice + 5*c.c_acctbal as pred_b,
        cast(c.c_nationkey as string) as grp, o.o_orderstatus as split from {orders} o join {customer} c on o.o_custkey = c.c_custkey""",
    "fx_edges": """select l_suppkey % 100 as src, l_partkey % 100 as dst, cast(count(*) as double) as weight
        from {lineitem} where l_suppkey % 100 <> l_partkey % 100 group by l_suppkey % 100, l_partkey % 100""",
    "fx_mut": """select concat('G', cast(user_id % 300 as string)) as gene, concat('S', cast(event_id % 177 as string)) as sample, event_type as variant_class from {events}""",
    "fx_scores": """select c_custkey as id, (c_acctbal + 1000)/11000 as efficacy, cast(c_custkey*37 % 101 as double)/100 as specificity,
        cast(c_custkey*53 % 101 as double)/100 as robustness, cast(c_custkey*71 % 101 as double)/100 as safety from {customer}""",
    "fx_samples": """select concat('S', cast(s_suppkey % 40 as string)) as sample, min(s_nationkey % 3) as lineage from {supplier} group by s_suppkey % 40""",
    "fx_cells": """select l_orderkey as cell, concat('G', cast(l_partkey % 200 as string)) as gene, cast(l_quantity as double) as n,
        l_orderkey % 24 as patient, case when l_orderkey % 3 = 0 then 'malignant' else 'other' end as class from {lineitem}""",
    "fx_records": """select event_id as example_id, concat('chr', cast(user_id % 22 + 1 as string)) as chrom, (event_id*7919) % 1000000 as start_pos,
        (event_id*7919) % 1000000 + 1000 as end_pos, concat('grp', cast(user_id % 50 as string)) as sample_group, event_type as study,
        cast(cast(ts as date) as string) as released from {events}""",
    "fx_marks": """select concat('G', cast(l_partkey % 500 as string)) as locus, case l_linenumber % 7 when 0 then 'H3K4me3' when 1 then 'H3K4me1' when 2 then 'H3K27ac'
        when 3 then 'H3K27me3' when 4 then 'H3K9me3' when 5 then 'H3K36me3' else 'CTCF' end as mark, l_discount * 40 as level from {lineitem}""",
    "fx_genes": """select concat('G', cast(p_partkey as string)) as gene, (p_retailprice - 900) / 300 as log2fc, cast(p_size as double) / 100 as amp,
        cast(p_partkey % 40 as double) / 80 as del, cast(p_partkey % 101 as double) / 100 as beta, cast(p_partkey % 71 as double) / 70 as det,
        cast(p_partkey % 11 as double) / 5 - 1 as residual, p_partkey % 13 = 0 as driver,
        case p_partkey % 4 when 0 then 'basal' when 1 then 'classical' else '' end as subtype, p_partkey % 97 = 0 as control from {part}""",
}
#: The only difference between the dialects: DuckDB replaces all matches only when told to.
SEQUENCE = """select doc_id as id, translate(upper(regexp_replace(text,'[^A-Za-z]',''{all})),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC') as seq from {{documents}}"""
VIEWS["fx_seq"] = SEQUENCE.format(all="")
GUIDES = """select item_id as guide_id, substr(translate(upper(regexp_replace(text,'[^A-Za-z]',''{all})),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC'),1,20) as guide from {{benchmark}}"""
VIEWS["fx_guides"] = GUIDES.format(all="")
DUCK = {"fx_seq": SEQUENCE.format(all=",'g'"), "fx_guides": GUIDES.format(all=",'g'")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needed})


def duck(body: str) -> str:
    """``body`` with the views that it names put before it."""
    found: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in found:
                need(DUCK.get(name, VIEWS[name]))
                if name not in found:
                    found.append(name)

    need(body)
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", DUCK.get(n, VIEWS[n])) for n in found}
    views = ", ".join(f"{n} as ({plain[n]})" for n in found)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}" if views and not body.lower().startswith("with recursive") else (f"with recursive {views}, {body[15:]}" if views else body)
    return f"with {views} {body}" if views else body
