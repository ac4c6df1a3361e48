"""Readers, sinks and streams. The text files are written from the driver's tables, so what is read is known to SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.iterate import scratch
from locusframe.plans.catalog import register
from locusframe.sources import readers as rd
from locusframe.sources import writers as wr
from locusframe.streaming import streams


def text(rows: DataFrame, *fields: str, sep: str = "\t", name: str = "text") -> str:
    """The path of a folder of text files with a line (or a block) a row."""
    path = scratch(rows.sparkSession, name)
    rows.select(F.concat_ws(sep, *[F.expr(f).cast("string") for f in fields]).alias("value")).write.text(path)
    return path


@register("s1_read_narrowpeak", "select chrom, start_pos, end_pos, name, 0.0::double as score, '+' as strand, signal from fx_peaks")
def s1(v):
    p = v("fx_peaks")
    return rd.read_narrowpeak(p.sparkSession, text(p, "chrom", "start_pos", "end_pos", "name", "'.'", "'+'", "signal"))


@register("s2_read_bed", "select chrom, start_pos, end_pos, symbol as name, 5.0::double as score, strand, 0.0::double as signal from fx_windows2k")
def s2(v):
    p = v("fx_windows2k")
    return rd.read_bed(p.sparkSession, text(p, "chrom", "start_pos", "end_pos", "symbol", "5", "strand"))


@register("s3_read_gene_tss", "select symbol, chrom, case when strand = '+' then tss else tss + 500 end as tss, strand, tss as start_pos, tss + 500 as end_pos from fx_loci")
def s3(v):
    p = v("fx_loci")
    return rd.read_gene_tss(p.sparkSession, text(p, "chrom", "'h'", "'gene'", "tss", "tss + 500", "'.'", "strand", "'.'", "concat('gene_id \"e\"; gene_name \"', symbol, '\";')"))


@register("s4_peak_activity", "select concat('hg', gene) as peak, 'chr1' as chrom, 0 as start_pos, 9 as end_pos, round(avg(value), 6) as mean, max(value)::double as top, round(log10(avg(value) + 0.001), 6) as activity from fx_matrix group by gene having avg(value) > 0")
def s4(v):
    e = v("fx_matrix").groupBy("gene").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"].cast("string")), "\t").alias("vs"))
    coords = e.select(F.concat(F.lit("hg"), "gene").alias("peak"), F.lit("chr1").alias("chrom"), F.lit(0).alias("start_pos"), F.lit(9).alias("end_pos"))
    found = rd.peak_activity(e.sparkSession, text(e, "concat('hg', gene)", "vs"), coords)
    return found.select("peak", "chrom", "start_pos", "end_pos", F.round("mean", 6).alias("mean"), "top", F.round("activity", 6).alias("activity"))


@register("s5_read_variants", "select chrom, start_pos, start_pos + 1 as end_pos, concat('rs', peak_id::varchar) as id from fx_peaks")
def s5(v):
    p = v("fx_peaks")
    return rd.read_variants(p.sparkSession, text(p, "case when peak_id % 2 = 0 then substring(chrom, 4) else concat('NC_', lpad(substring(chrom, 4), 6, '0'), '.11') end", "start_pos + 1", "concat('rs', peak_id)", "'A'"))


@register("s6_read_wide_matrix", "select sample as \"row\", gene, value::double as value from fx_matrix")
def s6(v):
    e = v("fx_matrix")
    genes = sorted(r[0] for r in e.select("gene").distinct().collect())  # a header
    wide = e.groupBy("sample").pivot("gene", genes).agg(F.first("value")).select("sample", *genes)
    path = scratch(e.sparkSession, "matrix")
    wide.coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    return rd.read_wide_matrix(e.sparkSession, path, "sample").where("value is not null")


@register("s7_read_catalog", "select gene as symbol, 'yes' as tf, beta as q from fx_genes where driver")
def s7(v):
    g = v("fx_genes")
    path = scratch(g.sparkSession, "catalog")
    g.select(F.col("gene").alias("HGNC symbol"), F.when(F.col("driver"), "yes").otherwise("no").alias("Is TF?"), F.col("beta").alias("Qvalue")).write.option("header", True).csv(path, sep="\t")
    return rd.read_catalog(g.sparkSession, path, rd.CatalogSpec({"symbol": ("HGNC symbol",), "tf": ("is tf?",), "q": ("qvalue",)}, numbers=("q",), equals={"tf": "Yes"}))


@register("s8_read_fasta", "select id::varchar as chrom, s as chunk_start, substr(seq, s + 1, 534) as seq from (select id, seq, unnest(range(0, length(seq), 512)) as s from fx_seq where length(seq) > 0)")
def s8(v):
    s = v("fx_seq").where("length(seq) > 0")
    return rd.read_fasta(s.sparkSession, text(s, "concat('>', id, ' from a document')", "regexp_replace(seq, '(.{60})', '$1\n')", sep="\n", name="fasta"), 512, 22)


@register("s9_read_signal", "select chrom, start_pos, end_pos, value::double as value from fx_track")
def s9(v):
    t = v("fx_track")
    return rd.read_signal(t.sparkSession, text(t, "chrom", "start_pos", "end_pos", "value"))


LETTERS = "l as (select substr(guide, 1, 1) as tf, i - 1 as pos, substr(guide, i, 1) as base from (select guide, unnest(range(1, 21)) as i from fx_guides where length(guide) = 20))"


@register("s10_read_pwms", f"""with {LETTERS}, n as (select tf, pos, count(*) as n from l group by tf, pos), b as (select unnest(['A', 'C', 'G', 'T']) as base)
    select tf, pos, base, round(log2(((select count(*) from l where l.tf = n.tf and l.pos = n.pos and l.base = b.base) + 0.8::double) / (n + 3.2::double) / 0.25::double), 6) as logodds from n, b""")
def s10(v):
    g = v("fx_guides").where("length(guide) = 20").select(F.substring("guide", 1, 1).alias("tf"), F.posexplode(F.slice(F.split("guide", ""), 1, 20)).alias("pos", "base"))
    counts = g.groupBy("tf", "pos").pivot("base", list("ACGT")).count().na.fill(0).groupBy("tf").agg(F.sort_array(F.collect_list(F.struct("pos", *"ACGT"))).alias("m"))
    path = text(counts, "concat('>MA_', tf, ' ', tf)", *[f"concat('{b} [ ', array_join(transform(m, x -> cast(x.{b} as string)), ' '), ' ]')" for b in "ACGT"], sep="\n", name="pwms")
    return rd.read_pwms(g.sparkSession, path).select("tf", F.col("pos").cast("long").alias("pos"), "base", F.round("logodds", 6).alias("logodds"))


@register("s11_read_soft", "select concat('GSM', substr(sample, 2)) as sample, concat('title of ', sample) as title, 'Homo sapiens' as organism, concat('line ', lineage::varchar) as tissue, '2020-01-02' as released from fx_samples")
def s11(v):
    s = v("fx_samples")
    path = text(s, "concat('^SAMPLE = GSM', substring(sample, 2))", "concat('!Sample_title = title of ', sample)", "'!Sample_organism_ch1 = Homo sapiens'", "concat('!Sample_characteristics_ch1 = Tissue: line ', lineage)", "'!Sample_status = Public on Jan 02 2020'", sep="\n", name="soft")
    return rd.read_soft(s.sparkSession, path).select("sample", "title", "organism", F.element_at("characteristics", "tissue")[0].alias("tissue"), F.col("released").cast("string").alias("released"))


@register("s12_read_manifests", "select s_name as name, s_suppkey as bytes from supplier")
def s12(v):
    docs = v("supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("bytes"))).alias("artifacts"))
    path = scratch(docs.sparkSession, "manifests")
    docs.select(F.to_json(F.struct("artifacts")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return rd.read_manifests(docs.sparkSession, f"{path}/*.txt", "name: string, bytes: long").where("name is not null").select("name", "bytes")


@register("s13_read_weights", "select gene as key, beta as weight from fx_genes")
def s13(v):
    g = v("fx_genes")
    return rd.read_weights(g.sparkSession, text(g, "gene", "cast(beta as string)", sep=" "), "G[0-9]+", g.count())


@register("s14_classify_filenames", """select example_id, concat('GSM', example_id::varchar) as sample, case example_id % 3 when 0 then 'ATAC-seq' when 1 then 'Histone ChIP-seq' else 'RNA-seq' end as assay, (example_id % 4 + 1)::int as replicate, case when example_id % 2 = 0 then 'bw' else 'bed' end as kind from fx_records""")
def s14(v):
    name = "concat('d/GSM', example_id, '_', case example_id % 3 when 0 then 'atac' when 1 then 'H3K27ac' else 'RNA' end, '_rep', example_id % 4 + 1, case when example_id % 2 = 0 then '.bw' else '.bed.gz' end)"
    return rd.classify_filenames(v("fx_records").select("example_id", F.expr(name).alias("f")), "f").drop("f")


COLUMNS = ("example_id", "chrom", "start_pos", "end_pos", "sample_group", "study")
RECORDS = f"select {', '.join(COLUMNS)} from fx_records"


@register("k1_write_windows", RECORDS)
def k1(v):
    rows = v("fx_records").select(*COLUMNS)
    path = scratch(rows.sparkSession, "windows")
    wr.write_windows(rows, path, 1000, "study")
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*COLUMNS)


@register("k2_write_sorted", "select chrom, count(*) as n, min(start_pos) as first, max(start_pos) as last, true as sorted from fx_records group by chrom")
def k2(v):
    rows = v("fx_records").select(*COLUMNS)
    path = scratch(rows.sparkSession, "sorted")
    wr.write_sorted(rows, path)
    # Files are sorted if the coordinates in them, as they are read, never go back.
    order = F.struct("chrom", "start_pos", "end_pos")
    back = rows.sparkSession.read.parquet(path).select("*", order.alias("o"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    seen = back.groupBy("chrom", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "o"))), lambda x: x["o"]).alias("a"), F.count("*").alias("m"), F.min("start_pos").alias("lo"), F.max("start_pos").alias("hi"))
    return seen.groupBy("chrom").agg(F.sum("m").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.min(F.col("a") == F.sort_array("a")).alias("sorted"))


@register("k3_write_jsonl", RECORDS)
def k3(v):
    rows = v("fx_records").select(*COLUMNS)
    path = scratch(rows.sparkSession, "jsonl")
    wr.write_jsonl(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


@register("k4_cached", RECORDS)
def k4(v):
    rows = v("fx_records").select(*COLUMNS)
    path = scratch(rows.sparkSession, "cached")
    wr.cached(rows.sparkSession, path, lambda _: rows)
    return wr.cached(rows.sparkSession, path, lambda _: rows.limit(0))


@register("k5_shard_manifest", "select count(*) as rows, 1 as collections, true as digests from fx_records")
def k5(v):
    rows = v("fx_records").select(*COLUMNS)
    path = scratch(rows.sparkSession, "shards")
    wr.write_windows(rows, path, 1000, "study")
    m = wr.shard_manifest(rows.sparkSession, path).agg(F.count_distinct("collection").cast("int").alias("collections"), F.min(F.length("sha256") == 64).alias("digests"))
    return rows.sparkSession.read.schema(rows.schema).parquet(path).agg(F.count("*").alias("rows")).crossJoin(F.broadcast(m))


SPLIT = "case when example_id % 5 = 0 then 'locus_test' else 'train' end"


def arriving(v) -> tuple[DataFrame, str]:
    """The records as they come in, a third of them twice."""
    rows = v("fx_records").select("example_id", "sample_group", "study", F.expr(SPLIT).alias("split"))
    path = scratch(rows.sparkSession, "arriving")
    rows.write.parquet(path)
    rows.where("example_id % 3 = 0").write.mode("append").parquet(path)
    return rows, path


@register("st1_stream_windows", f"select split, sample_group, count(*) as n from (select {SPLIT} as split, sample_group from fx_records) group by split, sample_group")
def st1(v):
    rows, path = arriving(v)
    spark, out = rows.sparkSession, scratch(rows.sparkSession, "stream")
    once = streams.stream_windows(spark, path, rows.schema)
    streams.run_once(once, scratch(spark, "stream-state"), "append", lambda df, n: df.write.mode("append").parquet(out))
    return streams.split_totals(spark.read.schema(rows.schema).parquet(out))


@register("st1_stream_once_per_id", f"select split, sample_group, count(*) as n from (select {SPLIT} as split, sample_group from fx_records) group by split, sample_group")
def st1_written(v):
    rows, path = arriving(v)
    spark, out = rows.sparkSession, scratch(rows.sparkSession, "stream")
    once = streams.OncePerId(scratch(spark, "ids"), "example_id", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    streams.run_once(streams.arriving_windows(spark, path, rows.schema), scratch(spark, "stream-state"), "append", once)
    return streams.split_totals(spark.read.schema(rows.schema).parquet(out))


@register("st2_stream_leakage", f"select sample_group, count(distinct split) > 1 as leak from (select {SPLIT} as split, sample_group from fx_records) group by sample_group")
def st2(v):
    rows, path = arriving(v)
    spark, out = rows.sparkSession, scratch(rows.sparkSession, "leaks")
    found = streams.stream_leakage(spark.readStream.schema(rows.schema).parquet(path), ["locus_test"])
    streams.run_once(found, scratch(spark, "leak-state"), "update", lambda df, n: df.withColumn("turn", F.lit(n)).write.mode("append").parquet(out))
    return spark.read.parquet(out).groupBy("sample_group").agg(F.max_by("leak", "turn").alias("leak"))
