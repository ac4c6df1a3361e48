"""Readers of genomic and metadata text formats. Bad fields become nulls or defaults as each docstring says."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    return lines.select(F.split("value", "\t").alias("f")).where(F.size("f") >= least)


def _number(i: int, kind: str = "double") -> Column:
    return F.get("f", F.lit(i)).try_cast(kind)


def _text(i: int) -> Column:
    return F.coalesce(F.get("f", F.lit(i)), F.lit("."))


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start_pos, end_pos, name, score, strand, signal); comment lines and rows under three fields go; ``.`` is 0."""
    return _fields(spark, path, 3).select(
        F.col("f")[0].alias("chrom"), _number(1, "long").alias("start_pos"), _number(2, "long").alias("end_pos"), _text(3).alias("name"),
        F.coalesce(_number(4), F.lit(0.0)).alias("score"), _text(5).alias("strand"), F.coalesce(_number(6), F.lit(0.0)).alias("signal"),
    ).where("start_pos is not null and end_pos is not null")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``read_narrowpeak`` of a format without a signal: it is 0."""
    return read_narrowpeak(spark, path).withColumn("signal", F.lit(0.0))


def read_gene_tss(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, chrom, tss, strand, start_pos, end_pos) of GTF gene rows, the first of each symbol in file order."""
    attribute = lambda k: F.regexp_extract(F.col("f")[8], rf'{k} "([^"]+)"', 1)
    rows = _fields(spark, path, 9).where(F.col("f")[2] == "gene").withColumn("symbol", attribute("gene_name")).where("symbol <> ''").withColumn("__n", F.monotonically_increasing_id())
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy("__n"))).where("r = 1")
    start, end, strand = _number(3, "long"), _number(4, "long"), F.col("f")[6]
    return rows.select("symbol", F.col("f")[0].alias("chrom"), F.when(strand == "+", start).otherwise(end).alias("tss"), strand.alias("strand"), start.alias("start_pos"), end.alias("end_pos"))


def peak_activity(spark: SparkSession, matrix: str, coords: DataFrame) -> DataFrame:
    """``coords`` (peak, chrom, start_pos, end_pos) with mean, top and log10(mean + 0.001) of ``hg*`` rows; mean of 0 or less goes."""
    rows = spark.read.text(matrix).select(F.split("value", "\t").alias("f")).where(F.col("f")[0].startswith("hg"))
    values = F.filter(F.transform(F.slice("f", 2, 1 << 20), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    rows = rows.select(F.col("f")[0].alias("peak"), values.alias("v")).where(F.size("v") > 0)
    rows = rows.select("peak", (F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")).alias("mean"), F.array_max("v").alias("top"))
    return coords.join(rows.where("mean > 0"), "peak").withColumn("activity", F.log10(F.col("mean") + 1e-3))


def normal_contig(c: Column) -> Column:
    """Contig names as chrN: accession numbers of the human assembly, bare numbers and names that are so already."""
    n = F.regexp_extract(c, r"^NC_0+(\d+)\.", 1).try_cast("int")
    named = F.when(n.between(1, 22), F.concat(F.lit("chr"), n.cast("string"))).when(n == 23, "chrX").when(n == 24, "chrY").when(n == 12920, "chrM")
    return F.coalesce(named, F.when(c.startswith("chr"), c).when(c.rlike("^([0-9]{1,2}|X|Y)$"), F.concat(F.lit("chr"), c)).when(c.isin("M", "MT"), "chrM"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start_pos, end_pos, id) from VCF, 0-based half-open; contigs that have no chrN name go."""
    pos = _number(1, "long")
    return _fields(spark, path, 3).select(normal_contig(F.col("f")[0]).alias("chrom"), (pos - 1).alias("start_pos"), pos.alias("end_pos"), F.col("f")[2].alias("id")).where("chrom is not null and end_pos is not null")


def read_wide_matrix(spark: SparkSession, path: str, id_col: str | None = None, sep: str = "\t", skip: int = 0, symbol_regex: str = r"^(\S+)(?: \(.*\))?$") -> DataFrame:
    """(row, gene, value) from a table with a column per gene; of columns with one symbol the first wins; not numbers are null.

    ``skip`` lines of preamble (GCT: 2) are passed over. The id column is found without regard to case.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = lines.limit(skip + 1).collect()[skip][0].split(sep)
    names = [h.strip().strip('"') for h in header]
    at = next((k for k, h in enumerate(names) if id_col and h.lower() == id_col.lower()), 0)
    seen: dict[str, int] = {}
    for k, h in enumerate(names):
        m = re.match(symbol_regex, h)
        if k != at and m:
            seen.setdefault(m[1], k)
    if not seen:
        return spark.createDataFrame([], "row string, gene string, value double")
    first = sep.join(header)
    rows = lines.where(F.col("value") != first).select(F.split("value", re.escape(sep)).alias("f")).where(F.size("f") == len(header))
    cells = F.array(*[F.struct(F.lit(g).alias("gene"), F.col("f")[k].try_cast("double").alias("value")) for g, k in seen.items()])
    return rows.select(F.col("f")[at].alias("row"), F.explode(cells).alias("c")).select("row", "c.gene", "c.value")


@dataclass
class CatalogSpec:
    """Columns wanted, each with the header names that may hold it, in order of preference."""

    columns: dict[str, Sequence[str]]
    numbers: Sequence[str] = ()
    equals: dict[str, str] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)


def read_catalog(spark: SparkSession, path: str, spec: CatalogSpec, sep: str = "\t") -> DataFrame:
    """A delimited table by a ``CatalogSpec``. Columns that no header names are null, fields that are no number too."""
    df = spark.read.csv(path, sep=sep, header=True)
    have = {c.strip().lower(): c for c in df.columns}
    pick = {n: next((have[x.lower()] for x in names if x.lower() in have), None) for n, names in spec.columns.items()}
    out = df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in pick.items()])
    for n in spec.numbers:
        out = out.withColumn(n, F.col(n).try_cast("double"))
    for n, v in spec.equals.items():
        out = out.where(F.lower(F.trim(n)) == v.lower())
    for n, v in spec.contains.items():
        out = out.where(F.lower(n).contains(v.lower()))
    return out


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start_pos, end_pos, value) of bedGraph; a value that is no number is null, rows without an end go."""
    return _fields(spark, path, 4).select(F.col("f")[0].alias("chrom"), _number(1, "long").alias("start_pos"), _number(2, "long").alias("end_pos"), _number(3).alias("value")).where("end_pos is not null")


def read_pwms(spark: SparkSession, path: str) -> DataFrame:
    """(tf, pos, base, logodds) from JASPAR count blocks: (c + 0.8) / (sum + 3.2), log2 over a quarter; the longest matrix of a name stays."""
    blocks = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^\S+\s+([^\n]+)", 1)
    rows = blocks.select(F.explode(F.split(F.trim(F.regexp_replace(name, r"\(.*$", "")), "::")).alias("tf"), "value")
    count = lambda b: F.transform(F.regexp_extract_all(F.regexp_extract("value", rf"(?m)^{b}\s*\[?([^\]\n]*)", 1), F.lit(r"([0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))
    rows = rows.select(F.upper("tf").alias("tf"), *[count(b).alias(b) for b in "ACGT"]).where(F.size("A") > 0)
    best = rows.groupBy("tf").agg(F.max_by(F.struct("A", "C", "G", "T"), F.size("A")).alias("m"))
    cells = best.select("tf", F.posexplode(F.arrays_zip(*[F.col(f"m.{b}").alias(b) for b in "ACGT"])).alias("pos", "c"))
    total = F.col("c.A") + F.col("c.C") + F.col("c.G") + F.col("c.T") + 3.2
    return cells.select("tf", "pos", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.log2((F.col(f"c.{b}") + 0.8) / total / 0.25).alias("logodds")) for b in "ACGT"])).alias("x")).select("tf", "pos", "x.base", "x.logodds")


def read_soft(spark: SparkSession, path: str) -> DataFrame:
    """(sample, title, organism, characteristics, processing, relations, files, released) from SOFT family text."""
    blocks = spark.read.text(path, lineSep="^SAMPLE = ").where(F.col("value").startswith("GSM"))
    lines = F.split("value", "\r?\n")
    pairs = F.filter(lines, lambda x: x.startswith("!Sample_") & x.contains(" = "))
    rows = blocks.select(F.trim(lines[0]).alias("sample"), F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^!Sample_(\S+) = ", 1).alias("k"), F.regexp_extract(x, r"^!Sample_\S+ = (.*)$", 1).alias("v"))).alias("p"))
    many = lambda *ks: F.transform(F.filter("p", lambda x: F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: x["k"].startswith(k))), lambda x: x["v"])
    one = lambda k: F.get(many(k), F.lit(0))
    traits = F.filter(many("characteristics_ch1"), lambda x: x.contains(":"))
    named = F.transform(traits, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(named, lambda x: x["k"]))
    grouped = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(named, lambda x: x["k"] == k), lambda x: x["v"])))
    date = F.to_date(F.regexp_extract(F.coalesce(one("status"), F.lit("")), r"([A-Z][a-z]{2} \d{1,2} \d{4})", 1).try_cast("string"), "MMM d yyyy")
    return rows.select("sample", one("title").alias("title"), one("organism_ch1").alias("organism"), grouped.alias("characteristics"), many("data_processing").alias("processing"), many("relation").alias("relations"),
                       F.filter(many("supplementary_file"), lambda x: x != "NONE").alias("files"), F.when(F.coalesce(one("status"), F.lit("")).rlike(r"[A-Z][a-z]{2} \d{1,2} \d{4}"), date).alias("released"))


def read_manifests(spark: SparkSession, glob: str, artifact: str | None = None) -> DataFrame:
    """A row per artifact of many JSON documents, with the file that it came from; ``artifact``, the fields of one, if they
    are known, so that documents without any give an empty table of these."""
    reader = spark.read.option("multiLine", True)
    docs = (reader.schema(f"artifacts array<struct<{artifact}>>") if artifact else reader).json(glob).withColumn("manifest", F.input_file_name())
    return docs.select("manifest", F.explode_outer("artifacts").alias("a")).select("manifest", "a.*")


def read_weights(spark: SparkSession, path: str, key_regex: str, expect: int | None = None) -> DataFrame:
    """(key, weight) of two-field text rows; ``expect`` rows or the read fails."""
    rows = spark.read.text(path).select(F.regexp_extract("value", rf"^\s*({key_regex})[\s,]+", 1).alias("key"), F.regexp_extract("value", r"[\s,]([-+0-9.eE]+)\s*$", 1).try_cast("double").alias("weight")).where("key <> '' and weight is not null")
    if expect is not None and (n := rows.count()) != expect:
        raise ValueError(f"{path}: {n} weights, not {expect}")
    return rows


def classify_filenames(df: DataFrame, c: str) -> DataFrame:
    """``df`` with sample, assay, replicate and kind read from a file name; a state is never inferred from it."""
    name = F.regexp_extract(c, r"([^/]+)$", 1)
    assay = F.when(F.lower(name).rlike("atac"), "ATAC-seq").when(F.lower(name).rlike("h3k[0-9]+(ac|me[123])"), "Histone ChIP-seq").when(F.lower(name).rlike("rna"), "RNA-seq")
    blank = lambda x: F.when(x != "", x)
    return df.select("*", blank(F.regexp_extract(name, r"(GSM[0-9]+)", 1)).alias("sample"), assay.alias("assay"), F.regexp_extract(F.lower(name), r"(?:rep|replicate)[_-]?([0-9]+)", 1).try_cast("int").alias("replicate"),
                     blank(F.regexp_extract(F.lower(name), r"\.(bigwig|bw|narrowpeak|bed|bam|bedgraph)(?:\.gz)?$", 1)).alias("kind"))


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 20, overlap: int = 22) -> DataFrame:
    """(chrom, chunk_start, seq): fixed chunks that overlap, from plain or compressed FASTA on any file system that Spark reads.

    Lines are read by Spark's splits, within a contig too. A line's contig and offset are those within its split plus
    what the splits before it in the file end with, one row a split. Blank lines are passed over; lines before the first
    name have no contig and go; a contig name in two files gives the chunks of both.
    """
    at = ["__file", "__block"]
    lines = spark.read.text(path).select(
        F.rtrim("value").alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__n")).where("value <> ''")
    named = lines.withColumn("__name", F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1)))
    lasts = named.groupBy(*at).agg(F.max_by("__name", F.when(F.col("__name").isNotNull(), F.col("__n"))).alias("__last"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*at, F.last("__last", True).over(earlier).alias("__before"))
    here = Window.partitionBy(*at).orderBy("__n")
    rows = named.withColumn("chrom", F.last("__name", True).over(here.rowsBetween(Window.unboundedPreceding, 0))).join(carried, at)
    rows = rows.withColumn("chrom", F.coalesce("chrom", "__before")).where("__name is null and chrom is not null").withColumn("__len", F.char_length("value"))
    sums = rows.groupBy(*at, "chrom").agg(F.sum("__len").alias("__sum"))
    ahead = Window.partitionBy("__file", "chrom").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*at, "chrom", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*at, "chrom").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum("__len").over(inside), F.lit(0))).join(sums, [*at, "chrom"]).withColumn("pos", F.col("__offset") + F.col("__in"))
    first, last = F.greatest(F.floor((F.col("pos") - overlap) / chunk), F.lit(0)), F.floor((F.col("pos") + F.col("__len") - 1) / chunk)
    parts = placed.select("__file", "chrom", "pos", "value", F.explode(F.sequence(first, last)).alias("c")).withColumn("chunk_start", F.col("c") * chunk)
    skip = F.greatest(F.col("chunk_start") - F.col("pos"), F.lit(0))
    piece = F.substr("value", (skip + 1).cast("int"), (F.col("chunk_start") + chunk + overlap - F.col("pos") - skip).cast("int"))
    whole = parts.groupBy("__file", "chrom", "chunk_start").agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("p")))).alias("x"))
    return whole.select("chrom", "chunk_start", F.array_join(F.transform("x", lambda x: x["p"]), "").alias("seq"))


def chunk_text(df: DataFrame, chrom: str, seq: str, chunk: int, overlap: int) -> DataFrame:
    """The same chunks from a table of whole sequences."""
    rows = df.where(F.char_length(seq) > 0).select(F.col(chrom).alias("chrom"), F.col(seq).alias("__s"), F.explode(F.sequence(F.lit(0), F.char_length(seq) - 1, F.lit(chunk))).alias("chunk_start"))
    return rows.select("chrom", F.col("chunk_start").cast("long").alias("chunk_start"), F.expr(f"substring(__s, chunk_start + 1, {chunk + overlap})").alias("seq"))


def check_assembly(chunks: DataFrame, expected: DataFrame, chunk: int) -> DataFrame:
    """(chrom, size, expected) of contigs whose size is not the expected one."""
    sizes = chunks.groupBy("chrom").agg(F.max(F.col("chunk_start") + F.least(F.char_length("seq"), F.lit(1 << 40))).alias("size"))
    both = sizes.join(expected.select("chrom", F.col("size").alias("expected")), "chrom", "full")
    return both.where(~F.col("size").eqNullSafe(F.col("expected")))
