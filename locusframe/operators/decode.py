"""Metadata decoding: characteristics to enumerations, vectors, selection and track specs. Errors are rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Histone targets by their slot in the assay vector; organisms and the genome builds of each; cell types by phrase.
TARGET_SLOTS = {"H3K27AC": 1, "H3K4ME1": 2, "H3K4ME3": 3, "H3K27ME3": 4, "H3K9ME3": 5}
ORGANISMS = {"Homo sapiens": ("human", ("hg19", "hg38")), "Mus musculus": ("mouse", ("mm9", "mm10"))}
STATES = (("normal pancreatic organoid", "healthy_pancreas"), ("panin organoid", "PanIN"), ("primary tumor organoid", "primary_PDAC"), ("liver metastasis", "metastatic_PDAC"), ("peritoneum metastasis", "metastatic_PDAC"))


def one_value(characteristics: str, *keys: str) -> Column:
    """Distinct values of any of the keys (map of lists): what there is, to be one."""
    lists = F.flatten(F.array(*[F.coalesce(F.try_element_at(F.col(characteristics), F.lit(k)), F.array().cast("array<string>")) for k in keys]))
    return F.array_distinct(F.filter(F.transform(lists, lambda x: F.trim(x)), lambda x: x != ""))


def decode_samples(df: DataFrame) -> DataFrame:
    """``df`` (sample, organism, characteristics, processing) with species, genome, state, perturbation and ``errors``."""
    organism = F.trim(F.regexp_replace(F.coalesce("organism", F.lit("")), r"\s+", " "))
    text = F.lower(F.array_join(F.coalesce("processing", F.array().cast("array<string>")), " "))
    species, genome = F, F.array().cast("array<string>")
    for name, (short, builds) in ORGANISMS.items():
        species = species.when(organism == name, short)
        genome = F.when(organism == name, F.array_compact(F.array(*[F.when(text.rlike(rf"\b{b}\b"), b) for b in builds]))).otherwise(genome)
    cells, changes = one_value("characteristics", "cell type"), one_value("characteristics", "perturbation", "peturbation")
    cell = F.regexp_replace(F.lower(F.coalesce(F.get(cells, F.lit(0)), F.lit(""))), r"\s+", " ")
    state = F
    for phrase, name in STATES:
        state = state.when(cell.contains(phrase), name)
    errors = F.array_compact(F.array(
        F.when(F.col("species").isNull(), "unsupported organism"), F.when(F.size("__g") != 1, "ambiguous genome"), F.when(F.size("__c") > 1, "conflicting cell type"),
        F.when((F.size("__c") <= 1) & F.col("state").isNull(), "unmapped cell type"), F.when(F.size("__p") > 1, "conflicting perturbation")))
    out = df.withColumns({"species": species, "__g": genome, "__c": cells, "__p": changes, "state": state})
    return out.withColumns({"genome": F.when(F.size("__g") == 1, F.col("__g")[0]), "perturbation": F.coalesce(F.get("__p", F.lit(0)), F.lit("none")), "errors": errors}).drop("__g", "__c", "__p")


def assay_vector(assay: str, target: str, output: str, status: str, errors: str) -> Column:
    """Twelve slots: open chromatin, five histone marks, factor, plus, minus, cap, methylation, quality."""
    a, t, o = F.lower(F.coalesce(assay, F.lit(""))), F.upper(F.coalesce(target, F.lit(""))), F.lower(F.coalesce(output, F.lit("")))
    has = lambda c, *xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: c.contains(x))
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    rna, cap, minus, plus = has(a, "rna"), has(a, "rampage", "cage"), has(o, "minus", "reverse"), has(o, "plus", "forward")
    slot7 = F.when((rna | cap) & ~minus & plus, 1.0).when(rna & ~minus & ~plus, 0.5).otherwise(0.0)
    slot8 = F.when((rna | cap) & minus, 1.0).when(rna & ~minus & ~plus, 0.5).otherwise(0.0)
    marks = [on(t == m) for m in TARGET_SLOTS]
    return F.array(on(has(a, "atac", "dnase")), *marks, on(has(a, "tf chip") | (t == "CTCF")), slot7, slot8, on(cap), on(has(a, "wgbs", "methyl")),
                   F.when((F.col(status) == "released") & ~F.coalesce(F.col(errors), F.lit(False)), 1.0).otherwise(0.5))


def slot_vector(c: str, slots: Sequence[str]) -> Column:
    """One-hot of a value over named slots; states and perturbations alike."""
    return F.array(*[(F.coalesce(F.col(c), F.lit("")) == s).cast("double") for s in slots])


def selection_reason(df: DataFrame, outputs: dict[str, Sequence[str]], targets: Sequence[str], status: str = "released") -> DataFrame:
    """``df`` with ``reason`` why a track is not selected; null if it is."""
    allowed = F.create_map(*[x for k, v in outputs.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    mine = F.try_element_at(allowed, F.coalesce("assay", F.lit("")))
    reason = F.when(~F.col("status").eqNullSafe(F.lit(status)), F.concat(F.lit("status is "), F.coalesce("status", F.lit("null")), F.lit(f", not {status}")))
    reason = reason.when(mine.isNull() & (F.col("assay") == "WGBS"), "coverage is not a methylation state").when(mine.isNull(), F.concat(F.lit("assay without condition semantics: "), F.coalesce("assay", F.lit("null"))))
    reason = reason.when(~F.coalesce(F.array_contains(mine, F.col("output_type")), F.lit(False)), "noncanonical output").when((F.col("assay") == "Histone ChIP-seq") & ~F.coalesce(F.col("target").isin(*targets), F.lit(False)), "unsupported histone target")
    return df.withColumn("reason", reason)


def track_specs(files: DataFrame, samples: DataFrame, holdout: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """Specs of eligible files: pair group, split role by holdout set, metadata map without forbidden keys."""
    rows = files.join(samples, "sample").where(F.size("errors") == 0)
    return rows.select(
        "accession", "sample", F.concat_ws("|", "species", "genome", "assay").alias("pair_group"),
        F.when(F.col("study").isin(*holdout), "external_study").otherwise("train").alias("split_role"), F.map_filter("metadata", lambda k, _: ~k.isin(*forbidden)).alias("metadata"))
