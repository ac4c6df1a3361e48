"""Window compilation, splits, pairing and truth tables. A row is a window; profiles are arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.intervals import BIN, overlap_join
from locusframe.operators.scan import running
from locusframe.operators.stats import hash_bits


def tile(sizes: DataFrame, length: int, stride: int | None = None) -> DataFrame:
    """(chrom, start_pos, end_pos) of whole windows; a last partial one is dropped.

    A null size, or one under the length, gives no window; a chromosome that comes twice is tiled twice.
    """
    rows = sizes.where(F.col("size") >= length)
    return rows.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - length, F.lit(stride or length).cast("long"))).alias("start_pos")).withColumn("end_pos", F.col("start_pos") + length)


def hash_order(seed, *cols: str) -> Column:
    """A digest of seed and columns to order rows by, the same in every run."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def sample_windows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows by hash of their key: a sample by intent."""
    return df.orderBy(hash_order(seed, *key), *key).limit(n)


def bin_signal(track: DataFrame, windows: DataFrame, key: str, bin_size: int, value: str = "value", size: int = BIN) -> DataFrame:
    """``windows`` with ``target`` and ``valid``: mean per bin weighted by covered bases; uncovered bins are 0 and not valid.

    Null, NaN and infinite values are passed over; windows that share a key share their values.
    """
    good = track.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    pairs = overlap_join(windows, good, size=size)
    lo, hi = F.greatest("start_pos", "b_start_pos") - F.col("start_pos"), F.least("end_pos", "b_end_pos") - F.col("start_pos")
    cells = pairs.select(key, lo.alias("lo"), hi.alias("hi"), F.col(f"b_{value}").alias("v")).withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {bin_size}"), F.expr(f"(hi - 1) div {bin_size}"))))
    n = F.least("hi", (F.col("bin") + 1) * bin_size) - F.greatest("lo", F.col("bin") * bin_size)
    means = cells.groupBy(key, "bin").agg((F.sum(n * F.col("v")) / F.sum(n)).alias("m")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("__m"))
    out = windows.join(means, key, "left")
    bins = F.sequence(F.lit(0).cast("long"), F.expr(f"(end_pos - start_pos) div {bin_size} - 1"))
    got = F.transform(bins, lambda i: F.try_element_at(F.col("__m"), i))
    return out.select(*windows.columns, F.transform(got, lambda x: F.coalesce(x, F.lit(0.0)).cast("float")).alias("target"), F.transform(got, lambda x: x.isNotNull()).alias("valid"))


def masked_mean(values: str, mask: str) -> Column:
    """Mean of the values whose mask is true; null without any. Null values are passed over."""
    kept = F.filter(F.zip_with(values, mask, lambda v, m: F.when(m, v.cast("double"))), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept))


def filter_windows(df: DataFrame, key: str, eps: float, keep: float, seed: int) -> DataFrame:
    """Windows with a valid bin; those with a mean of at most ``eps`` stay with probability ``keep`` (hash draw)."""
    quiet = masked_mean("target", "valid") <= eps
    return df.where(F.exists("valid", lambda v: v)).where(~quiet | (hash_bits(seed, F.col(key).cast("string")) < keep))


@dataclass
class SplitPolicy:
    validation: Sequence[str] = ("chr6", "chr7")
    test: Sequence[str] = ("chr8", "chr9")
    held_out_groups: Sequence[str] = ()
    external_studies: Sequence[str] = ()
    cutoff: str = "9999-12-31"
    names: dict[str, str] = field(default_factory=dict)


def assign_split(df: DataFrame, policy: SplitPolicy) -> DataFrame:
    """``df`` with ``split``: external, temporal, joint, state, locus, validation, train, in this order."""
    isin = lambda c, xs: F.coalesce(F.col(c).isin(*xs), F.lit(False)) if xs else F.lit(False)
    state, locus = isin("sample_group", policy.held_out_groups), isin("chrom", policy.test)
    late = F.coalesce((F.col("released") != "") & (F.col("released") > policy.cutoff), F.lit(False))
    chain = F.when(isin("study", policy.external_studies), "external_study_test").when(late, "temporal_test").when(state & locus, "joint_locus_state_test")
    return df.withColumn("split", chain.when(state, "state_test").when(locus, "locus_test").when(isin("chrom", policy.validation), "validation").otherwise("train"))


def split_by_role(df: DataFrame, policy: SplitPolicy | None = None) -> DataFrame:
    """``df`` with ``split`` from ``split_role`` and chromosome."""
    policy = policy or SplitPolicy()
    locus = F.col("chrom").isin(*policy.test)
    role = F.col("split_role")
    chain = F.when(role == "validation_study", "validation").when(role == "external_study", "external_study_test").when(role == "temporal_test", "temporal_test")
    chain = chain.when(role == "held_out_state", F.when(locus, "joint_locus_state_test").otherwise("state_test"))
    return df.withColumn("split", chain.when(F.col("chrom").isin(*policy.validation), "validation").when(locus, "locus_test").otherwise("train"))


def chrom_split(df: DataFrame, validation: Sequence[str], test: Sequence[str]) -> DataFrame:
    """``df`` with its split by chromosome; a null chromosome is train."""
    return df.withColumn("split", F.when(F.col("chrom").isin(*test), "test").when(F.col("chrom").isin(*validation), "val").otherwise("train"))


def group_split(df: DataFrame, group: str, val_share: float, test_share: float, seed: int) -> DataFrame:
    """Whole groups by hash rank: the first shares go to test and val. Groups are ranked, not rows.

    Rows with a null group have no split and go; rows of a group stay together however many; shares round to whole
    groups.
    """
    groups = df.select(group).distinct()
    n = groups.count()
    ranked = running(groups.withColumn("__h", hash_order(seed, group)), [], ["__h", group], {"__r": F.lit(1)}, alone=True)
    name = F.when(F.col("__r") <= round(n * test_share), "test").when(F.col("__r") <= round(n * test_share) + round(n * val_share), "val").otherwise("train")
    return df.join(ranked.select(group, name.alias("split")), group)


def hash_split(df: DataFrame, key: str, salt: str, val_share: float, test_share: float) -> DataFrame:
    """``df`` with its split by a salted hash of the key, so a key keeps its split."""
    u = hash_bits(salt, F.col(key).cast("string"))
    return df.withColumn("split", F.when(u < test_share, "test").when(u < test_share + val_share, "val").otherwise("train"))


def scan_windows(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), splits: Sequence[str] = (), ids: DataFrame | None = None, key: str = "example_id") -> DataFrame:
    """Filters that reach the file scan: studies in, studies out, splits, ids."""
    if include:
        df = df.where(F.col("study").isin(*include))
    if exclude:
        df = df.where(~F.col("study").isin(*exclude))
    if splits:
        df = df.where(F.col("split").isin(*splits))
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")


def forbidden_splits(df: DataFrame, studies: Sequence[str], allowed: str = "validation") -> DataFrame:
    """Violations: rows of validation-only studies with another split, counted."""
    return df.where(F.col("study").isin(*studies) & (F.col("split") != allowed)).groupBy("study", "split").count()


def pad_zero_vector(c: str, n: int) -> Column:
    """An all-zero vector drawn out (or cut) to n; any other must have n already, or the row fails."""
    v = F.col(c)
    return F.when(F.size(v) == n, v).when(F.forall(v, lambda x: x == 0), F.array_repeat(F.lit(0.0), n)).otherwise(F.raise_error(F.lit(f"{c}: width is not {n} and values are not zero")))


def retile(df: DataFrame, tile_bp: int, bin_size: int, arrays: Sequence[str], key: str = "example_id") -> DataFrame:
    """Local tiles of long windows with their slices of every profile, and the parent's id.

    Windows shorter than a tile are for the caller to leave out; a null array gives null slices; an empty table gives
    no tiles.
    """
    per = tile_bp // bin_size
    rows = df.withColumn("tile", F.explode(F.sequence(F.lit(0), F.expr(f"(end_pos - start_pos) div {tile_bp} - 1").cast("int"))))
    rest = [c for c in df.columns if c not in (key, "start_pos", "end_pos", *arrays)]
    return rows.select(
        F.concat_ws(":", key, "tile").alias(key), F.col(key).alias("parent"), "tile", *rest, (F.col("start_pos") + F.col("tile") * tile_bp).alias("start_pos"),
        (F.col("start_pos") + (F.col("tile") + 1) * tile_bp).alias("end_pos"), *[F.slice(a, F.col("tile") * per + 1, F.lit(per)).alias(a) for a in arrays])


def pair_windows(ref: DataFrame, trt: DataFrame, on: Sequence[str] = ("chrom", "start_pos", "end_pos")) -> DataFrame:
    """(on, delta, valid, side): full-outer match by coordinates; delta is treatment less reference, valid is both masks.

    A null coordinate matches nothing; windows that come twice on a side pair with each of the other; a null target is
    no window of its side.
    """
    on = list(on)
    r = ref.select(*on, F.col("target").alias("__rt"), F.col("valid").alias("__rv"))
    t = trt.select(*on, F.col("target").alias("__tt"), F.col("valid").alias("__tv"))
    both = F.col("__rt").isNotNull() & F.col("__tt").isNotNull()
    return r.join(t, on, "full").select(
        *on, F.when(both, F.zip_with("__tt", "__rt", lambda a, b: a - b)).alias("delta"), F.when(both, F.zip_with("__tv", "__rv", lambda a, b: a & b)).alias("valid"),
        F.when(both, "matched").when(F.col("__rt").isNotNull(), "reference_only").otherwise("treatment_only").alias("side"))


def pair_gate(pairs: DataFrame, min_overlap: float) -> DataFrame:
    """One row: matched, reference_only, treatment_only, overlap (of the smaller side), passes."""
    n = lambda s: F.coalesce(F.sum((F.col("side") == s).cast("long")), F.lit(0)).alias(s)
    out = pairs.agg(n("matched"), n("reference_only"), n("treatment_only"))
    small = F.col("matched") + F.least("reference_only", "treatment_only")
    return out.withColumn("overlap", F.when(small > 0, F.col("matched") / small).otherwise(0.0)).withColumn("passes", F.col("overlap") >= min_overlap)


def check_pairs(df: DataFrame) -> DataFrame:
    """Violations of pair contracts in (pair_id, ref_*, trt_* columns): one row per pair and reason."""
    bad = F.array_compact(F.array(
        F.when(~F.col("ref_genome").eqNullSafe(F.col("trt_genome")), "genome differs"), F.when(F.coalesce("ref_pair_group", F.lit("")) == "", "no pair group"),
        F.when(~F.col("ref_pair_group").eqNullSafe(F.col("trt_pair_group")), "pair group differs"), F.when(~F.col("ref_relation").eqNullSafe(F.lit("control")), "reference is no control"),
        F.when(~F.col("trt_relation").eqNullSafe(F.lit("intervention")), "treatment is no intervention"), F.when(~F.col("ref_bins").eqNullSafe(F.col("trt_bins")), "lengths differ")))
    return df.select("pair_id", F.explode(bad).alias("reason"))


def pair_plan(df: DataFrame, same: Sequence[str] = ("genome", "assay")) -> DataFrame:
    """(pair_group, accession, control, status, reason): each intervention with its group's one control, or why not."""
    role = F.col("pair_relation")
    groups = df.groupBy("pair_group").agg(F.sum((role == "control").cast("int")).alias("controls"), F.sum((role == "intervention").cast("int")).alias("interventions"))
    control = df.where(role == "control").groupBy("pair_group").agg(F.min_by(F.struct("accession", *same), "accession").alias("c"))
    rows = df.where(role == "intervention").join(groups, "pair_group").join(control, "pair_group", "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(s).eqNullSafe(F.col(f"c.{s}")), s) for s in same]))
    reason = F.when(F.coalesce("pair_group", F.lit("")) == "", "no pair group").when(F.col("controls") == 0, "no control").when(F.col("controls") > 1, "several controls").when(F.size(differs) > 0, F.concat(F.array_join(differs, ","), F.lit(" differs")))
    out = rows.select("pair_group", "accession", F.col("c.accession").alias("control"), reason.alias("reason"))
    alone = df.where(role == "control").join(groups.where("interventions = 0").select("pair_group"), "pair_group").select("pair_group", "accession", F.lit(None).cast(df.schema["accession"].dataType).alias("control"), F.lit("no intervention").alias("reason"))
    both = out.unionByName(alone)
    return both.withColumn("status", F.when(F.col("reason").isNull(), "paired").otherwise("unresolved"))


def replicate_gate(df: DataFrame, registered: DataFrame, min_n: int) -> DataFrame:
    """(grp, assay, n, reason) of registered cells with too few replicates and of cells that are not registered."""
    n = df.groupBy("grp", "assay").agg(F.count("*").alias("n"))
    both = registered.select("grp", "assay").distinct().withColumn("__r", F.lit(True)).join(n, ["grp", "assay"], "full")
    reason = F.when(F.col("__r").isNull(), "not registered").when(F.coalesce("n", F.lit(0)) < min_n, "too few replicates")
    return both.select("grp", "assay", F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason")).where("reason is not null")


def recenter(df: DataFrame, length: int, sizes: DataFrame) -> DataFrame:
    """Windows drawn out or cut to ``length`` about their centre; ``dropped`` marks those past a chromosome's edge."""
    extra = length - (F.col("end_pos") - F.col("start_pos"))
    half = F.when(extra % 2 == 0, F.expr(f"({length} - (end_pos - start_pos)) div 2")).otherwise(F.raise_error(F.lit("the difference in length is odd")))
    out = df.withColumn("__h", half).withColumn("start_pos", F.col("start_pos") - F.col("__h")).withColumn("end_pos", F.col("end_pos") + F.col("__h")).drop("__h")
    return out.join(F.broadcast(sizes.select("chrom", "size")), "chrom", "left").withColumn("dropped", (F.col("start_pos") < 0) | F.coalesce(F.col("end_pos") > F.col("size"), F.lit(True))).drop("size")


def hash_topn_per_stratum(df: DataFrame, strata: Sequence[str], n: int, seed: int, key: str) -> DataFrame:
    """The first n of each stratum by sha256(seed:id). Salted: each of 64 parts keeps n before they meet."""
    order = hash_order(seed, key)
    rows = df.withColumn("__o", order).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*strata, "__salt").orderBy("__o", key))).where(F.col("place") <= n)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy("__o", key))).where(F.col("place") <= n).drop("__o", "__salt")


def center_crop(c: str, n: int) -> Column:
    """The middle ``n`` elements of an array at least that long."""
    return F.slice(c, F.expr(f"(size({c}) - {n}) div 2 + 1"), F.lit(n))


def freeze_truth(df: DataFrame, ids: DataFrame, target: str, mask: str, key: str = "example_id") -> DataFrame:
    """(key, target, mask) of the rows with the given ids; repeated rows stay."""
    return df.join(ids.select(key).distinct(), key, "left_semi").select(key, F.col(target).alias("target"), F.col(mask).alias("mask"))


def truth_violations(df: DataFrame, ids: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, reason): ids that the table lacks or holds twice."""
    twice = df.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("reason"))
    return twice.unionByName(ids.select(key).distinct().join(df, key, "left_anti").select(key, F.lit("missing").alias("reason")))


def quality_filter(df: DataFrame, vector: str, least: float) -> DataFrame:
    """Rows whose last element is at least ``least``; rows with a null or empty vector go."""
    return df.where(F.element_at(vector, -1) >= least)
