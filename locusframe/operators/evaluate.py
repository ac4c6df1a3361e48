"""Prediction evaluation and audits. Audits return tables of violations; ``assert_empty`` makes them fail."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.stats import conformal_radius, grouped_scores, pearson, poisson_weight

#: Data classes from best to worst.
DATA_CLASSES = ("REAL", "DERIVED", "POINTER", "SYNTHETIC", "PLACEHOLDER")


def assert_empty(violations: DataFrame) -> None:
    """Raise with the first violations, if there are any."""
    first = violations.head(5)
    if first:
        raise ValueError(f"violations: {first}")


def elements(df: DataFrame, key: Sequence[str], arrays: dict[str, str]) -> DataFrame:
    """(key, pos, names): a row per element of parallel arrays."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(*key, F.posexplode(zipped).alias("pos", "z")).select(*key, "pos", *[F.col(f"z.{n}").alias(n) for n in arrays])


def align(a: DataFrame, b: DataFrame, key: str, same: Sequence[str], target: str, tol: float = 1e-6) -> DataFrame:
    """(key, reason): ids that one side lacks, fields that differ, targets apart by more than ``tol``.

    A null key matches nothing and comes as lacking on the other side; equal nulls agree; a null target does not
    drift; ids should come once a side.
    """
    left = a.select(key, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in (*same, target)])
    right = b.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in (*same, target)])
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("__b").isNull(), "only in a"), F.when(F.col("__a").isNull(), "only in b"),
        *[F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs") for c in same],
        F.when(both & (F.abs(F.col(f"a_{target}") - F.col(f"b_{target}")) > tol), "target drifts")))
    return left.join(right, key, "full").select(key, F.explode(reasons).alias("reason"))


def merge_predictions(parts: Sequence[DataFrame], key: str, identity: str, values: str) -> tuple[DataFrame, DataFrame]:
    """(merged, violations): more than one identity, ids that come twice, lengths that differ."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    twice = merged.groupBy(F.col(key).cast("string").alias("item")).count().where("count > 1").select("item", F.lit("duplicate id").alias("reason"))
    kinds = merged.agg(F.count_distinct(identity).alias("i"), F.count_distinct(F.size(values)).alias("s"))
    more = kinds.select(F.explode(F.array_compact(F.array(F.when(F.col("i") > 1, "several identities"), F.when(F.col("s") > 1, "several lengths")))).alias("reason")).select(F.lit(None).cast("string").alias("item"), "reason")
    return merged, twice.unionByName(more)


def contrast(ref: DataFrame, trt: DataFrame, key: str, values: str, same: Sequence[str] = ()) -> DataFrame:
    """(key, delta, drift): treatment less reference on matched ids; drift names identity fields that differ."""
    r = ref.select(key, F.col(values).alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in same])
    t = trt.select(key, F.col(values).alias("__t"), *[F.col(c).alias(f"__t_{c}") for c in same])
    drift = F.array_compact(F.array(*[F.when(~F.col(f"__r_{c}").eqNullSafe(F.col(f"__t_{c}")), c) for c in same])) if same else F.array().cast("array<string>")
    return r.join(t, key).select(key, F.zip_with("__t", "__r", lambda a, b: a - b).alias("delta"), drift.alias("drift"))


def ensemble(df: DataFrame, key: str, seed: str, values: str, seeds: Sequence[int]) -> DataFrame:
    """(key, values, complete): element-wise mean over seeds; complete if exactly the registered seeds are there."""
    rows = df.select(key, seed, F.posexplode(values).alias("pos", "v"))
    mean = rows.groupBy(key, "pos").agg(F.avg("v").alias("v")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("l"))
    have = df.groupBy(key).agg(F.array_sort(F.collect_list(seed)).alias("s"))
    return mean.join(have, key).select(key, F.transform("l", lambda x: x["v"]).alias(values), (F.col("s") == F.array(*[F.lit(s) for s in sorted(seeds)])).alias("complete"))


def group_conformal(cal: DataFrame, target: DataFrame, level: float, group: str = "grp", min_groups: int = 3, non_negative: bool = True) -> DataFrame:
    """``target`` with lower and upper: the radius is the order statistic of each group's largest masked error.

    ``cal`` has (grp, target, prediction, mask) as scalars or exploded elements. Under ``min_groups`` groups the radius is null.
    """
    worst = cal.where("mask").groupBy(group).agg(F.max(F.abs(F.col("target") - F.col("prediction"))).alias("e"))
    n = worst.agg(F.count("*").alias("__g"))
    radius = conformal_radius(worst, "e", level).crossJoin(n).select(F.when(F.col("__g") >= min_groups, F.col("radius")).alias("radius"))
    low = F.col("prediction") - F.col("radius")
    return target.crossJoin(F.broadcast(radius)).withColumn("lower", F.greatest(low, F.lit(0.0)) if non_negative else low).withColumn("upper", F.col("prediction") + F.col("radius"))


def interval_calibration(df: DataFrame, nominal: float = 0.9, min_groups: int = 5, max_ratio: float = 4.0, group: str = "grp") -> DataFrame:
    """One row: coverage (mean over groups), width, target spread, their ratio, tolerance, and what passes."""
    inside = F.col("target").between(F.col("lower"), F.col("upper")).cast("double")
    cover = df.groupBy(group).agg(F.avg(inside).alias("c")).agg(F.avg("c").alias("coverage"), F.count("*").alias("groups"))
    spread = df.agg(F.avg(F.col("upper") - F.col("lower")).alias("width"), (F.percentile("target", 0.75) - F.percentile("target", 0.25)).alias("iqr"), F.stddev_pop("target").alias("sd"))
    out = cover.crossJoin(spread).withColumn("iqr", F.when(F.col("iqr") > 1e-12, F.col("iqr")).otherwise(F.greatest("sd", F.lit(1e-12)))).drop("sd")
    out = out.withColumn("ratio", F.col("width") / F.col("iqr")).withColumn("tolerance", F.greatest(F.lit(0.02), 1.96 * F.sqrt(F.lit(nominal * (1 - nominal)) / F.greatest("groups", F.lit(1)))))
    return out.withColumn("coverage_ok", F.col("coverage") >= nominal - F.col("tolerance")).withColumn("groups_ok", F.col("groups") >= min_groups).withColumn("sharpness_ok", F.col("ratio") <= max_ratio)


def compare_models(df: DataFrame, metric: str, target: str, a: str, b: str, group: str, draws: int = 500, seed: int = 0, min_groups: int = 5) -> DataFrame:
    """One row: delta = mean over groups of score(a) - score(b), 95 % interval and one-sided p by Poisson bootstrap of groups."""
    scores = grouped_scores(df, metric, target, a, [group]).withColumnRenamed("score", "sa").join(grouped_scores(df, metric, target, b, [group]).withColumnRenamed("score", "sb"), group)
    rows = scores.select(F.col(group).cast("string").alias("g"), (F.col("sa") - F.col("sb")).alias("d"))
    turns = F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "__r"))
    w = poisson_weight(seed, F.col("__r").cast("string"), F.col("g"))
    each = rows.crossJoin(turns).groupBy("__r").agg(F.try_divide(F.sum(w * F.col("d")), F.sum(w)).alias("s"))
    tails = each.agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"), ((F.coalesce(F.sum((F.col("s") <= 0).cast("int")), F.lit(0)) + 1) / (F.count("s") + 1)).alias("p"))
    out = rows.agg(F.avg("d").alias("delta"), F.count("*").alias("groups")).crossJoin(tails)
    reason = F.when(F.col("groups") < min_groups, "too few groups").when(F.col("lo") <= 0, "interval reaches 0").otherwise("passes")
    return out.withColumn("reason", reason)


def check_groups(df: DataFrame, allowed: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, reason): groups that are not registered, and registered ones that are missing."""
    have, want = df.select(group).distinct(), allowed.select(group).distinct()
    return have.join(want, group, "left_anti").withColumn("reason", F.lit("unexpected")).unionByName(want.join(have, group, "left_anti").withColumn("reason", F.lit("missing")))


def leakage_audit(df: DataFrame, key: str, train: str, held_out: Sequence[str], known: Sequence[str]) -> DataFrame:
    """(kind, n): groups, intervals and studies shared between train and held-out, duplicate ids, unknown splits."""
    side = F.when(F.col("split") == train, 1).when(F.col("split").isin(*held_out), 2)
    rows = df.withColumn("__side", side)

    def shared(kind: str, *cols: str) -> DataFrame:
        both = rows.where("__side is not null").groupBy(*cols).agg(F.min("__side").alias("a"), F.max("__side").alias("b"))
        return both.agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    twice = df.groupBy(key).count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("n")).select(F.lit("duplicate ids").alias("kind"), "n")
    odd = df.agg(F.coalesce(F.sum((~F.col("split").isin(*known)).cast("long")), F.lit(0)).alias("n")).select(F.lit("unknown splits").alias("kind"), "n")
    return shared("groups", "sample_group").unionByName(shared("intervals", "chrom", "start_pos", "end_pos")).unionByName(shared("studies", "study")).unionByName(twice).unionByName(odd)


def split_counts(df: DataFrame) -> DataFrame:
    """(split, n, groups) over all rows; null splits are one split, null groups are not counted."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("sample_group").alias("groups"))


def scope_audit(df: DataFrame, studies: Sequence[str], allowed: str) -> DataFrame:
    """(study, splits, ok) of registered studies; one without rows has no splits and is not ok."""
    want = df.sparkSession.createDataFrame([(s,) for s in studies], "study string")
    got = df.where(F.col("study").isin(*studies)).groupBy("study").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return want.join(got, "study", "left").withColumn("ok", F.coalesce(F.col("splits") == F.array(F.lit(allowed)), F.lit(False)))


def grams(df: DataFrame, seed: str, key: str, factors: str) -> DataFrame:
    """(a, b, i, j, s, sa, sb): centred cross products of factor columns of each pair of seeds, over common ids."""
    means = df.select(seed, F.posexplode(factors).alias("i", "v")).groupBy(seed, "i").agg(F.avg("v").alias("m"))
    long = df.select(seed, key, F.posexplode(factors).alias("i", "v")).join(F.broadcast(means), [seed, "i"]).select(seed, key, "i", (F.col("v") - F.col("m")).alias("v"))
    a = long.select(F.col(seed).alias("a"), key, "i", F.col("v").alias("x"))
    b = long.select(F.col(seed).alias("b"), key, F.col("i").alias("j"), F.col("v").alias("y"))
    return a.join(b, key).where(F.col("a") <= F.col("b")).groupBy("a", "b", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))


def stability_audit(df: DataFrame, seed: str, key: str, factors: str, cka: float = 0.5) -> DataFrame:
    """(a, b, cka, nrmse, effective_rank, top_share, ok) for each pair of seeds, from d x d cross products only."""

    def judge(rows: pa.Table) -> pa.Table:
        pdf = rows.to_pandas()
        d = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        m = {}
        for (p, q), g in pdf.groupby(["a", "b"]):
            m[p, q] = np.zeros((d, d))
            m[p, q][g["i"], g["j"]] = g["s"]
        out = []
        for (p, q), cross in sorted(m.items()):
            if p == q:
                continue
            kp, kq = m[p, p], m[q, q]
            score = (cross**2).sum() / max(np.sqrt((kp**2).sum() * (kq**2).sum()), 1e-12)
            nuclear = np.linalg.svd(cross, compute_uv=False).sum()
            rest = max(0.0, 1 - (nuclear**2) / max(np.trace(kp) * np.trace(kq), 1e-12))
            values = np.clip(np.linalg.eigvalsh(kp)[::-1], 0, None)
            share = values / max(values.sum(), 1e-12)
            out.append((p, q, score, float(np.sqrt(rest)), float(np.exp(-(share[share > 0] * np.log(share[share > 0])).sum())), float(share[0]), bool(score >= cka)))
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("a", "b", "cka", "nrmse", "effective_rank", "top_share", "ok"), cols, (pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.bool_()))})

    return grams(df.withColumn(seed, F.col(seed).cast("long")), seed, key, factors).withColumn("all", F.lit(1)).groupBy("all").applyInArrow(judge, "a long, b long, cka double, nrmse double, effective_rank double, top_share double, ok boolean")


def pooled(c: str, factor: int) -> Column:
    """Means of whole runs of ``factor`` elements."""
    n = F.expr(f"size({c}) div {factor}")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(c, i * factor + 1, F.lit(factor)), F.lit(0.0), lambda s, x: s + x) / factor)


def profile_metrics(df: DataFrame, key: str, target: str, pred: str, mask: str, factors: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """(key, mse_1, mse_2, .., r): masked squared errors of pooled profiles and masked correlation. A pool counts if whole."""
    def error(f: int) -> Column:
        good = F.transform(F.sequence(F.lit(0), F.expr(f"size({mask}) div {f}") - 1), lambda i: F.forall(F.slice(mask, i * f + 1, F.lit(f)), lambda m: m))
        gap = F.zip_with(F.zip_with(pooled(target, f), pooled(pred, f), lambda a, b: (a - b) * (a - b)), good, lambda e, g: F.when(g, e))
        kept = F.filter(gap, lambda e: e.isNotNull())
        return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, e: s + e) / F.size(kept))

    out = df.withColumns({f"mse_{f}": error(f) for f in factors})
    rows = elements(df, [key], {"t": target, "p": pred, "m": mask}).where("m")
    r = rows.groupBy(key).agg(pearson("t", "p").alias("r"))
    return out.join(r, key, "left").select(key, *[f"mse_{f}" for f in factors], "r")


def verify_provenance(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(name, reason) of artifacts (name, status, sha256, bytes, path) against files (path, sha256, bytes)."""
    got = files.select("path", F.col("sha256").alias("__h"), F.col("bytes").alias("__b"))
    real = F.col("status") == "materialized"
    reason = F.when(~F.col("status").isin("materialized", "pointer", "failed"), "unknown status").when(real & F.col("sha256").isNull(), "no digest").when(real & F.col("__h").isNull(), "not materialised")
    reason = reason.when(real & (F.col("__h") != F.col("sha256")), "tampered").when(real & F.col("bytes").isNotNull() & (F.col("__b") != F.col("bytes")), "size differs")
    return artifacts.join(got, "path", "left").select("name", reason.alias("reason"))


def inventory(df: DataFrame, by: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Rows, bytes and rows of each status per ``by``; null bytes and statuses are passed over."""
    return df.groupBy(*by).agg(F.count("*").alias("artifacts"), F.sum("bytes").alias("bytes"), *[F.sum((F.col("status") == s).cast("long")).alias(s) for s in statuses])


def reduce_data_class(df: DataFrame, by: Sequence[str], c: str = "data_class", order: Sequence[str] = DATA_CLASSES) -> DataFrame:
    """The worst class of each group; an unknown one is worse than all."""
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, k)]), F.col(c)), F.lit(len(order)))
    return df.groupBy(*by).agg(F.max_by(c, place).alias(c))


def guard_text(df: DataFrame, columns: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """``df`` with ``blocked``: the text columns that match a forbidden pattern."""
    bad = "|".join(f"(?:{p})" for p in patterns)
    return df.withColumn("blocked", F.array_compact(F.array(*[F.when(F.col(c).rlike(bad), c) for c in columns])))


def verify_compiled(spec: DataFrame, manifest: DataFrame, key: str, same: Sequence[str], files: DataFrame | None = None) -> DataFrame:
    """(key, failures): fields that differ between spec and manifest, rows that one lacks, digests that do not hold."""
    a = spec.select(key, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in same])
    b = manifest.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in same])
    out = a.join(b, key, "full")
    tests = [F.when(F.col("__b").isNull(), "no manifest"), F.when(F.col("__a").isNull(), "no spec"), *[F.when(F.col("__a") & F.col("__b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs") for c in same]]
    if files is not None:
        out = out.join(files.select(key, F.col("sha256").alias("__f")), key, "left")
        tests.append(F.when(F.col("__f").isNull(), "no file"))
    return out.select(key, F.array_compact(F.array(*tests)).alias("failures")).where(F.size("failures") > 0)


def regex_target_map(desc: DataFrame, rules: DataFrame, c: str = "description") -> DataFrame:
    """(rule, n, targets, ok): descriptions that match each rule (rule, pattern, least, most); rules are a catalogue."""
    rows = desc.crossJoin(F.broadcast(rules)).where(F.expr(f"{c} rlike pattern"))
    got = rows.groupBy("rule").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("index")).alias("targets"))
    out = rules.join(got, "rule", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("rule", "n", "targets", F.col("n").between(F.col("least"), F.col("most")).alias("ok"))
