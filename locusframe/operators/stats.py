"""Rank statistics, metrics, resampling. Randomness is the rank or bits of sha2(seed:id), so runs repeat anywhere.

Statistics over ranks work on value counts: a row per distinct value, with running totals over range slices of values. No
step orders a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.tails import normal_tail, student_tail
from locusframe.operators.iterate import written
from locusframe.operators.scan import running

def hash_bits(*parts) -> Column:
    """A uniform draw in [0, 1): the first 48 bits of sha2(part:part:...)."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def value_ranks(df: DataFrame, value: str, sums: Sequence[str] = (), part: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: n, before (rows with a smaller value) and, for each of ``sums``, its sum and its sum before.

    Null values are passed over, NaN is the largest value, null parts are a part; an empty table gives no rows.
    """
    part = list(part)
    rows = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums])
    seen = running(rows, part, [value], {f"before_{c}": F.col(c) for c in ("n", *sums)}, alone=True, before=True)
    before = lambda c: F.coalesce(F.col(f"before_{c}"), F.lit(0))
    return seen.select(*part, value, "n", *sums, before("n").alias("before"), *[before(s).alias(f"before_{s}") for s in sums])


def avg_rank(df: DataFrame, value: str, part: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the average rank of ties (from 1) and ``<name>_pct``, (rank - 1) / (n - 1)."""
    ranks = value_ranks(df, value, part=part).select(*part, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    total = df.where(F.col(value).isNotNull()).groupBy(*part).agg(F.count("*").alias("__n"))
    out = df.join(ranks, [*part, value], "left")
    out = out.join(F.broadcast(total), list(part), "left") if part else out.crossJoin(F.broadcast(total))  # one row if there are no parts
    return out.withColumn(f"{name}_pct", F.when(F.col("__n") > 1, (F.col(name) - 1) / (F.col("__n") - 1)).otherwise(0.0)).drop("__n")


def pearson(x, y) -> Column:
    """Pearson r of two columns as an aggregate; null under two pairs or if one is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    # ``corr`` divides by zero under ANSI if a column is constant, whatever guards it.
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def spearman(df: DataFrame, x: str, y: str, part: Sequence[str] = ()) -> DataFrame:
    """(part, spearman, n) by Pearson of average ranks; pairs with a null are passed over; null if a side is constant."""
    ranked = avg_rank(avg_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, part, "__rx"), y, part, "__ry")
    return ranked.groupBy(*part).agg(pearson("__rx", "__ry").alias("spearman"), F.count("*").alias("n"))


def auroc(df: DataFrame, label: str, score: str, part: Sequence[str] = ()) -> DataFrame:
    """(part, auroc, n_pos, n_neg) by rank sum over value counts; null without both classes."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("__pos", (F.col(label) > 0).cast("long"))
    ranks = value_ranks(rows, score, ["__pos"], part)
    sums = ranks.groupBy(*part).agg(
        F.sum(F.col("__pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("__pos").alias("n_pos"), F.sum(F.col("n") - F.col("__pos")).alias("n_neg"))
    p, n = F.col("n_pos"), F.col("n_neg")
    return sums.select(*part, F.when((p > 0) & (n > 0), (F.col("r") - p * (p + 1) / 2) / (p * n)).alias("auroc"), "n_pos", "n_neg")


def average_precision(df: DataFrame, label: str, score: str, part: Sequence[str] = ()) -> DataFrame:
    """Threshold-grouped: precision at each distinct score, weighted by the recall that it adds.

    Rows with a null are passed over, ties share a threshold; null without a positive row.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("__pos", (F.col(label) > 0).cast("long")).withColumn("__neg", -F.col(score))
    ranks = value_ranks(rows, "__neg", ["__pos"], part)
    hits, seen = F.col("before___pos") + F.col("__pos"), F.col("before") + F.col("n")
    total = ranks.groupBy(*part).agg(F.sum(F.col("__pos") * hits / seen).alias("s"), F.sum("__pos").alias("p"))
    return total.select(*part, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"))


def auprc_rows(df: DataFrame, label: str, score: str, tie: str, part: Sequence[str] = ()) -> DataFrame:
    """Per row: rows in score order (ties by ``tie``, the table's order), precision at each positive row."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*part, (F.col(label) > 0).cast("long").alias("__pos"), (-F.col(score)).alias("__neg"), F.col(tie).alias("__tie"))
    run = running(rows, part, ["__neg", "__tie"], {"hits": F.col("__pos"), "seen": F.lit(1)}, alone=True)
    out = run.groupBy(*part).agg(F.sum(F.col("__pos") * F.col("hits") / F.col("seen")).alias("s"), F.sum("__pos").alias("p"))
    return out.select(*part, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("auprc"))


def ndcg(df: DataFrame, gain: str, score: str, k: int, tie: str) -> DataFrame:
    """NDCG over the first k; both orders are top-k picks, not sorts of the table.

    Null scores come last and null gains add nothing; 0 without any gain.
    """
    def dcg(order, name):
        top = df.orderBy(order, F.asc(tie)).limit(k)
        return top.withColumn("r", F.row_number().over(Window.orderBy(order, F.asc(tie)))).agg(F.sum(F.col(gain) / F.log2(F.col("r") + 1)).alias(name))

    both = dcg(F.desc(score), "got").crossJoin(dcg(F.desc(gain), "ideal"))
    return both.select(F.when(F.col("ideal") > 0, F.col("got") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def ece(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of probability.

    Rows with a null are passed over; 1 falls into the last bin; null without rows.
    """
    at = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    cells = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    return cells.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def precision_at_k(df: DataFrame, label: str, score: str, ks: Sequence[int], tie: str) -> DataFrame:
    """(k, precision) of the first k rows by score, ties by ``tie``; k rows count even if there are fewer."""
    top = df.orderBy(F.desc(score), F.asc(tie)).limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))
    cuts = df.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    return F.broadcast(cuts).join(top, F.col("r") <= F.col("k")).groupBy("k").agg((F.sum(F.col(label).cast("double")) / F.col("k")).alias("precision"))


def _registry(target: Column, pred: Column) -> dict[str, Column]:
    """Named metrics as aggregate columns. Rank metrics take rank columns."""
    sign = lambda c: F.signum(c)
    asinh = lambda c: F.asinh(c)
    return {
        "pearson": pearson(target, pred),
        "direction_accuracy": F.avg((sign(target) == sign(pred)).cast("double")),
        "neg_mae_log1p": -F.avg(F.abs(F.log1p(F.greatest(target, F.lit(0.0))) - F.log1p(F.greatest(pred, F.lit(0.0))))),
        "neg_mae_asinh": -F.avg(F.abs(asinh(target) - asinh(pred))),
    }


def grouped_scores(df: DataFrame, metric: str, target: str, pred: str, by: Sequence[str], mask: str | None = None) -> DataFrame:
    """(by, score) per group, of rows whose ``mask`` is true if one is named; groups whose score is not finite are dropped."""
    df = df.where(F.col(mask)) if mask else df
    if metric == "spearman":
        out = spearman(df, target, pred, by).withColumnRenamed("spearman", "score").drop("n")
    elif metric == "average_precision":
        out = average_precision(df, target, pred, by).withColumnRenamed("average_precision", "score")
    else:
        out = df.groupBy(*by).agg(_registry(F.col(target), F.col(pred))[metric].alias("score"))
    return out.where(F.col("score").isNotNull() & ~F.isnan("score"))


def grouped_metrics(df: DataFrame, metrics: Sequence[str], target: str, pred: str, by: Sequence[str], mask: str | None = None) -> DataFrame:
    """(by, metric..) with a column per metric, null where not finite: one aggregate for all that need no ranks."""
    df = df.where(F.col(mask)) if mask else df
    known = _registry(F.col(target), F.col(pred))
    out = df.groupBy(*by).agg(F.count("*").alias("__n"), *[F.nanvl(known[m], F.lit(None).cast("double")).alias(m) for m in metrics if m in known]).drop("__n")
    for m in metrics:
        if m not in known:
            out = out.join(grouped_scores(df, m, target, pred, by).withColumnRenamed("score", m), list(by), "left")
    return out.select(*by, *metrics)


def bh_fdr(df: DataFrame, p: str, part: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """``df`` with Benjamini-Hochberg ``q`` and ``rejected``. Null p keeps a null q."""
    ranks = value_ranks(df, p, part=part)
    total = ranks.groupBy(*part).agg(F.sum("n").alias("__m"))
    ranks = ranks.join(F.broadcast(total), list(part)) if part else ranks.crossJoin(F.broadcast(total))
    raw = ranks.select(*part, p, (-F.col(p)).alias("__down"), (F.col(p) * F.col("__m") / (F.col("before") + F.col("n"))).alias("__raw"))
    q = running(raw, part, ["__down"], {"q": F.col("__raw")}, "min", alone=True).select(*part, p, F.least("q", F.lit(1.0)).alias("q"))
    return df.join(q, [*part, p], "left").withColumn("rejected", F.col("q") <= alpha)


def mann_whitney(df: DataFrame, group: str, value: str, part: Sequence[str] = (), alternative: str = "two-sided") -> DataFrame:
    """(part, n1, n2, u, z, p) of rows with ``group`` true against the rest; normal tail with ties and continuity."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).withColumn("__one", F.col(group).cast("boolean").cast("long"))
    ranks = value_ranks(rows, value, ["__one"], part)
    out = ranks.groupBy(*part).agg(
        F.sum(F.col("__one") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("__one").alias("n1"), F.sum(F.col("n") - F.col("__one")).alias("n2"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    off = F.col("u") - n1 * n2 / 2
    shift = {"two-sided": F.abs(off) - 0.5, "greater": off - 0.5, "less": -off - 0.5}[alternative]
    out = out.withColumn("u", u).where("n1 > 0 and n2 > 0").withColumn("z", F.when(spread > 0, shift / spread).otherwise(0.0))
    tail = normal_tail("z")
    return out.select(*part, "n1", "n2", "u", "z", (F.least(2 * tail, F.lit(1.0)) if alternative == "two-sided" else tail).alias("p"))


def wilcoxon(df: DataFrame, x: str, y: str, part: Sequence[str] = ()) -> DataFrame:
    """Signed-rank test of paired columns, zeros dropped: (part, n, w_plus, z, p), two-sided normal tail.

    Pairs with a null are passed over, ties share their average rank; a part without a difference has no row.
    """
    rows = df.withColumn("__d", F.col(x) - F.col(y)).where("__d <> 0").withColumn("__a", F.abs("__d")).withColumn("__up", (F.col("__d") > 0).cast("long"))
    ranks = value_ranks(rows, "__a", ["__up"], part)
    out = ranks.groupBy(*part).agg(
        F.sum(F.col("__up") * (F.col("before") + (F.col("n") + 1) / 2)).alias("w_plus"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = out.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / spread)
    return out.select(*part, "n", "w_plus", "z", F.least(2 * normal_tail(F.abs("z")), F.lit(1.0)).alias("p"))


def hash_split_order(seed: int | Column, replicate: Column, key: str) -> Column:
    """A digest to order rows by in a replicate, the same in every run."""
    return F.sha2(F.concat_ws(":", F.lit(seed), replicate.cast("string"), F.col(key).cast("string")), 256)


#: Rows of a table of replicates and parts that is sent to all tasks.
FEW = 100_000


def smallest_hashes(df: DataFrame, key: str, k: DataFrame, draws: int, seed: int = 0, bin_rows: int = 50_000, part: Sequence[str] = ()) -> DataFrame:
    """(part, __r, key): in each of ``draws`` replicates of a part the rows with the k smallest hashes; ``k`` has a row a part.

    A threshold search: hashes are counted in bins, as many as the rows ask for, so the bin that the k-th falls into holds
    about ``bin_rows`` of a replicate's rows; bins before it are taken whole and only its rows are ordered. Equal keys have
    equal hashes and come in any order. Work is draws x rows.
    """
    part = list(part)
    bins = max(1, -(-df.count() // bin_rows))
    turns = F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "__r"))
    keyed = df.groupBy(F.col(key).alias("__k")).agg(F.collect_list(F.struct(*part)).alias("__parts")) if part else df.select(F.col(key).alias("__k"))
    rows = keyed.crossJoin(turns).withColumn("__h", hash_split_order(seed, F.col("__r"), "__k"))  # a key's hash serves all its parts
    rows = rows.withColumn("__bin", F.floor(F.conv(F.substring("__h", 1, 12), 16, 10).cast("double") / float(1 << 48) * bins).cast("int"))
    rows = rows.select("__r", "__k", "__h", "__bin", F.inline("__parts")) if part else rows
    counts = rows.groupBy(*part, "__r", "__bin").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*part, "__r").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    wanted = k.select(*part, F.col("k").alias("__want"))
    open_ = (before.join(wanted, part) if part else before.crossJoin(F.broadcast(wanted))).where(F.col("__before") < F.col("__want"))
    ends = open_.groupBy(*part, "__r").agg(F.max("__bin").alias("__last"), F.max_by(F.struct("__before", "__n", "__want"), "__bin").alias("e"))
    ends = written(ends.select(*part, "__r", "__last", "e.*"), "hashes")
    # A row a replicate and part: sent to the tasks, so only rows up to the k-th are moved.
    found = rows.join(F.broadcast(ends) if ends.count() <= FEW else ends, [*part, "__r"]).where(F.col("__bin") <= F.col("__last"))
    whole = (F.col("__bin") < F.col("__last")) | (F.col("__before") + F.col("__n") <= F.col("__want"))
    last = found.where(~whole).withColumn("__i", F.row_number().over(Window.partitionBy(*part, "__r").orderBy("__h")))
    taken = last.where(F.col("__i") <= F.col("__want") - F.col("__before"))
    return found.where(whole).select(*part, "__r", "__k").unionByName(taken.select(*part, "__r", "__k")).withColumnRenamed("__k", key)


def permutation_p(df: DataFrame, x: str, y: str, key: str, draws: int, seed: int = 0, statistic: Callable[[str, str], Column] = pearson, two_sided: bool = True, smoothing: bool = True) -> DataFrame:
    """(observed, ge, p): ``y`` is dealt anew by hash rank in each of ``draws`` replicates; (1 + ge) / (draws + 1), or the bare share.

    Work is draws x rows: aggregate to groups before when rows are many.
    Rows with a null on either side are passed over; keys must name rows; a replicate or table whose statistic is null
    counts as no hit.
    """
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("__k"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    observed = base.agg(statistic("__x", "__y").alias("observed"))
    turns = F.broadcast(base.sparkSession.range(draws).withColumnRenamed("id", "__r"))  # replicates: a stated number, not rows against rows
    one = F.lit(1).cast("long")
    left = running(base.select("__k", "__x"), [], ["__k"], {"__n": one}, alone=True).select("__x", "__n").crossJoin(turns)
    deals = base.select("__k", "__y").crossJoin(turns).withColumn("__h", hash_split_order(seed, F.col("__r"), "__k")).select("__r", "__h", "__k", "__y")
    right = running(deals, ["__r"], ["__h", "__k"], {"__n": one}, alone=True).select("__r", "__y", "__n")
    each = left.join(right, ["__r", "__n"]).groupBy("__r").agg(statistic("__x", "__y").alias("s"))
    hit = F.when(F.abs("s") >= F.abs("observed") - 1e-12, 1).otherwise(0) if two_sided else F.when(F.col("s") >= F.col("observed") - 1e-12, 1).otherwise(0)
    out = each.crossJoin(F.broadcast(observed)).groupBy("observed").agg(F.sum(hit).alias("ge"))
    return out.withColumn("p", (F.col("ge") + 1) / (draws + 1) if smoothing else F.col("ge") / draws)


def exact_permutation_p(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One-sided exact p of Pearson r over all orders, for n! of at most 40320 (n <= 8 rows, by contract)."""
    base = df.select(F.col(key).alias("__k"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    n = base.count()
    if n > 8:
        raise ValueError("exact permutation takes 8 rows at most")
    lists = base.agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__x"))), lambda s: s["__x"]).alias("xs"), F.collect_list("__y").alias("ys"))
    orders = lists.select("xs", F.transform("ys", lambda v: v).alias("ys"), F.array().cast("array<int>").alias("o"))
    for _ in range(n):
        orders = orders.select("xs", "ys", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(n)), "o")).alias("i"), "o").select("xs", "ys", F.concat("o", F.array("i")).alias("o"))
    dot = F.aggregate(F.zip_with("xs", F.transform("o", lambda i: F.element_at("ys", i)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    seen = base.agg(F.sum(F.col("__x") * F.col("__y")).alias("seen"))
    return orders.select(dot.alias("d")).crossJoin(seen).agg(F.avg((F.col("d") >= F.col("seen") - 1e-12).cast("double")).alias("p"))


def poisson_weight(*parts) -> Column:
    """A Poisson(1) draw from a hash: how often a row is in a bootstrap replicate."""
    total, term, steps = 0.0, 0.36787944117144233, []
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    # A one-element transform names the draw, so it is hashed once and not for each step.
    return F.transform(F.array(hash_bits(*parts)), lambda u: reduce(Column.__add__, [(u >= t).cast("int") for t in steps]))[0]


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of values by weights, as an aggregate; null without weight."""
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def weighted_median(value: Column, weight: Column) -> Column:
    """Median of values that count as often as their weights say, as an aggregate."""
    return F.percentile(value, 0.5, weight)


def weighted_spread(value: Column, weight: Column) -> Column:
    """Standard deviation with n - 1 below."""
    n, s = F.sum(weight), F.sum(weight * value)
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(weight * value * value) - F.try_divide(s * s, n), n - 1)))


def bootstrap_ci(df: DataFrame, value: str, key: str, draws: int, seed: int = 0, level: float = 0.95, statistic: Callable[[Column, Column], Column] = weighted_mean) -> DataFrame:
    """(estimate, lo, hi, used) of a statistic of a column and whole-number weights, by default the mean: Poisson bootstrap, one pass; each replicate is a weighted
    statistic in the same aggregate. A replicate that draws no row has no value and is passed over; ``used`` counts the others. Null values are passed over."""
    turns = F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "__r"))
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("__k"), F.col(value).alias("__v")).crossJoin(turns)
    w = poisson_weight(seed, F.col("__r").cast("string"), F.col("__k"))
    each = rows.withColumn("__w", w).where("__w > 0").groupBy("__r").agg(statistic(F.col("__v"), F.col("__w")).alias("s"))
    tails = each.agg(F.percentile("s", (1 - level) / 2).alias("lo"), F.percentile("s", (1 + level) / 2).alias("hi"), F.count("s").alias("used"))
    return df.where(F.col(value).isNotNull()).agg(statistic(F.col(value), F.lit(1)).alias("estimate")).crossJoin(tails)


def paired_bootstrap(df: DataFrame, a: str, b: str, key: str, draws: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """bootstrap_ci of the paired difference a - b."""
    return bootstrap_ci(df.withColumn("__d", F.col(a) - F.col(b)), "__d", key, draws, seed, level)


def bootstrap_auc(df: DataFrame, label: str, a: str, b: str, key: str, draws: int, seed: int = 0) -> DataFrame:
    """(auc_a, auc_b, delta, lo, hi, p, used): paired AUC difference by Poisson bootstrap; weighted rank sums per replicate.

    Replicates without both classes have no AUC and are passed over; ``used`` counts the others."""
    turns = F.broadcast(df.sparkSession.range(-1, draws).withColumnRenamed("id", "__r"))  # -1: the data as they are
    rows = df.select(F.col(key).cast("string").alias("__k"), F.col(label).cast("int").alias("__y"), a, b).crossJoin(turns)
    w = F.when(F.col("__r") < 0, 1).otherwise(poisson_weight(seed, F.col("__r").cast("string"), F.col("__k")))
    rows = rows.withColumn("__w", w).where("__w > 0")

    def auc(score: str, name: str) -> DataFrame:
        cells = rows.groupBy("__r", score).agg(F.sum(F.col("__w") * F.col("__y")).alias("p"), F.sum(F.col("__w") * (1 - F.col("__y"))).alias("q"))
        below = running(cells, ["__r"], [score], {"below": F.col("q")}, alone=True, before=True)
        won = below.withColumn("won", F.col("p") * (F.coalesce("below", F.lit(0)) + F.col("q") / 2)).groupBy("__r").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
        return won.select("__r", F.try_divide(F.col("won"), F.col("p") * F.col("q")).alias(name))

    each = auc(a, "auc_a").join(auc(b, "auc_b"), "__r").withColumn("d", F.col("auc_a") - F.col("auc_b"))
    drawn = each.where("__r >= 0").agg(
        F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"), F.count("d").alias("used"))
    return each.where("__r < 0").select("auc_a", "auc_b", F.col("d").alias("delta")).crossJoin(drawn)


def wilson_ci(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; [0, 1] without trials."""
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def tost(df: DataFrame, group: str, value: str, margin: float, part: Sequence[str] = ()) -> DataFrame:
    """Welch equivalence test of two groups (``group`` true or false): (part, diff, df, p_lower, p_upper, p).

    Null values are passed over; a part with under two rows of a group has a null p.
    """
    one = F.col(group).cast("boolean")
    stats = df.groupBy(*part).agg(*[f(F.when(w, F.col(value))).alias(n + s) for s, w in (("1", one), ("0", ~one)) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    freedom = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n0") - 1))
    return _equivalence(stats.select(*part, (F.col("m1") - F.col("m0")).alias("diff"), F.sqrt(a + b).alias("se"), freedom.alias("df")), margin)


def _equivalence(out: DataFrame, margin: float) -> DataFrame:
    """The two one-sided tests; without spread p is 0 for a difference within the margin and 1 beyond."""
    out = out.withColumn("t_lower", F.try_divide(F.col("diff") + margin, F.col("se"))).withColumn("t_upper", F.try_divide(margin - F.col("diff"), F.col("se")))
    out = out.withColumn("p_lower", student_tail("t_lower", "df")).withColumn("p_upper", student_tail("t_upper", "df"))
    flat = F.when(F.abs("diff") < margin, 0.0).otherwise(1.0)
    return out.withColumn("p", F.when(F.col("se") == 0, flat).otherwise(F.greatest("p_lower", "p_upper")))


def tost_paired(df: DataFrame, a: str, b: str, margin: float, part: Sequence[str] = ()) -> DataFrame:
    """Paired equivalence test of a - b over rows with both: (part, diff, se, df, t_lower, t_upper, p_lower, p_upper, p)."""
    rows = df.withColumn("__d", F.col(a) - F.col(b)).where("__d is not null")
    stats = rows.groupBy(*part).agg(F.avg("__d").alias("diff"), F.var_samp("__d").alias("v"), F.count("*").alias("n")).where("n > 1")
    return _equivalence(stats.select(*part, "diff", F.sqrt(F.col("v") / F.col("n")).alias("se"), (F.col("n") - 1).cast("double").alias("df")), margin)


def conformal_radius(df: DataFrame, score: str, level: float, part: Sequence[str] = ()) -> DataFrame:
    """(part, radius): the order statistic ceil((n + 1) * level), clipped to n, by value counts.

    Null scores are passed over and ties count each; a part without scores has no row.
    """
    ranks = value_ranks(df, score, part=part)
    n = ranks.groupBy(*part).agg(F.sum("n").alias("__n"))
    ranks = ranks.join(F.broadcast(n), list(part)) if part else ranks.crossJoin(F.broadcast(n))
    k = F.least(F.ceil((F.col("__n") + 1) * level), F.col("__n"))
    return ranks.where((F.col("before") < k) & (k <= F.col("before") + F.col("n"))).select(*part, F.col(score).alias("radius"))


def coverage_rate(df: DataFrame, target: str, lower: str, upper: str, part: Sequence[str] = ()) -> DataFrame:
    """(part, coverage, width) of intervals; rows with a null are passed over."""
    return df.groupBy(*part).agg(F.avg(F.col(target).between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"), F.avg(F.col(upper) - F.col(lower)).alias("width"))


def jackknife(df: DataFrame, value: str, part: Sequence[str] = (), estimator: str = "mean") -> DataFrame:
    """Spread of leave-one-out estimates in closed form, a ``mean`` or a ``variance``: (part, lo, hi, range, std).

    What is left out changes a mean or a sum of squares by a term of its own, so a row's estimate needs its part's moments
    only. ``std`` has n - 1 below. Parts of too few values (2 for a mean, 3 for a variance) have no row; nulls are passed over.
    """
    if estimator not in ("mean", "variance"):
        raise ValueError(f"no closed form for {estimator}; leave_one_out takes any")
    rows = df.where(F.col(value).isNotNull()).select(*part, F.col(value).cast("double").alias("__x"))
    moments = rows.groupBy(*part).agg(F.avg("__x").alias("__m"), F.var_pop("__x").alias("__v"), F.count("*").alias("__n"))
    moments = moments.where(F.col("__n") > (1 if estimator == "mean" else 2))
    both = rows.join(moments, list(part)) if part else rows.crossJoin(F.broadcast(moments))  # one row if there are no parts
    n, gap = F.col("__n"), F.col("__x") - F.col("__m")
    left = F.col("__m") - gap / (n - 1) if estimator == "mean" else (n * F.col("__v") - gap * gap * n / (n - 1)) / (n - 2)
    out = both.withColumn("__e", left).groupBy(*part).agg(F.min("__e").alias("lo"), F.max("__e").alias("hi"), F.stddev_samp("__e").alias("std"))
    return out.select(*part, "lo", "hi", (F.col("hi") - F.col("lo")).alias("range"), "std")


def matched_auc(df: DataFrame, label: str, score: str, covariate: str, calipers: Sequence[float], key: str) -> DataFrame:
    """(caliper, pairs, concordance): positives against negatives with a covariate gap of at most the caliper; ties half.

    A band join in bins of the caliper's width; without pairs the concordance is a half.
    """
    spark = df.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(float(c),) for c in calipers], "caliper double"))
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(score).alias("s"), F.col(covariate).cast("double").alias("c")).crossJoin(cuts)
    rows = rows.groupBy("caliper", "y", "s", "c").agg(F.count("*").alias("m")).withColumn("cell", F.floor(F.col("c") / F.col("caliper")))
    pos = rows.where("y > 0").select("caliper", F.col("s").alias("ps"), F.col("c").alias("pc"), F.col("m").alias("pm"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    pairs = pos.join(rows.where("y = 0"), ["caliper", "cell"]).where(F.abs(F.col("pc") - F.col("c")) <= F.col("caliper"))
    m = F.col("pm") * F.col("m")
    win = F.when(F.col("ps") > F.col("s"), 1.0).when(F.col("ps") == F.col("s"), 0.5).otherwise(0.0)
    out = pairs.groupBy("caliper").agg(F.sum(m).alias("pairs"), (F.sum(m * win) / F.sum(m)).alias("concordance"))
    return cuts.join(out, "caliper", "left").select("caliper", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("concordance", F.lit(0.5)).alias("concordance"))


def matched_auc_null(df: DataFrame, label: str, score: str, covariate: str, calipers: Sequence[float], key: str, draws: int, seed: int = 0) -> DataFrame:
    """(caliper, pairs, concordance, ge, p): ``matched_auc`` with p the share of ``draws`` in which as many rows, chosen by
    hash rank, do at least as well; a draw without a pair does a half. Work is draws x band join."""
    rows = df.select(F.col(key).alias("__k"), (F.col(label) > 0).cast("int").alias("__y"), F.col(score).alias("__s"), F.col(covariate).cast("double").alias("__c")).where("__y is not null and __s is not null and __c is not null")
    spark, n_pos = df.sparkSession, rows.agg(F.sum("__y").alias("k"))
    turns = F.broadcast(spark.range(draws).withColumnRenamed("id", "__r"))
    chosen = smallest_hashes(rows, "__k", n_pos, draws, seed).withColumn("__one", F.lit(1))
    dealt = rows.drop("__y").crossJoin(turns).join(chosen, ["__r", "__k"], "left").withColumn("__y", F.coalesce("__one", F.lit(0))).drop("__one", "__k")
    cuts = F.broadcast(spark.createDataFrame([(float(c),) for c in calipers], "caliper double"))
    cells = dealt.crossJoin(cuts).groupBy("caliper", "__r", "__y", "__s", "__c").agg(F.count("*").alias("m")).withColumn("cell", F.floor(F.col("__c") / F.col("caliper")))
    pos = cells.where("__y > 0").select("caliper", "__r", F.col("__s").alias("ps"), F.col("__c").alias("pc"), F.col("m").alias("pm"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    m, win = F.col("pm") * F.col("m"), F.when(F.col("ps") > F.col("__s"), 1.0).when(F.col("ps") == F.col("__s"), 0.5).otherwise(0.0)
    each = pos.join(cells.where("__y = 0").drop("__y"), ["caliper", "__r", "cell"]).where(F.abs(F.col("pc") - F.col("__c")) <= F.col("caliper")).groupBy("caliper", "__r").agg((F.sum(m * win) / F.sum(m)).alias("__d"))
    every = cuts.crossJoin(turns).join(each, ["caliper", "__r"], "left").withColumn("__d", F.coalesce("__d", F.lit(0.5)))
    seen = matched_auc(df, label, score, covariate, calipers, key)
    hit = every.join(F.broadcast(seen), "caliper").groupBy("caliper", "pairs", "concordance").agg(F.count_if(F.col("__d") >= F.col("concordance") - 1e-12).alias("ge"))
    return hit.withColumn("p", F.col("ge") / draws)


def stratified_auc(df: DataFrame, label: str, score: str, covariate: str, key: str, n: int = 3) -> DataFrame:
    """AUROC within n bands of the covariate, sizes as equal as can be, larger bands first.

    Rows without a covariate are in no band, ties of it go by ``key``; a band without both classes has a null AUC.
    """
    total = df.where(F.col(covariate).isNotNull()).count()
    base, more = divmod(total, n)
    edge = more * (base + 1)
    band = F.when(F.col("__p") < edge, F.floor(F.col("__p") / (base + 1))).otherwise(more + F.floor((F.col("__p") - edge) / max(base, 1)))
    rows = running(df.where(F.col(covariate).isNotNull()), [], [covariate, key], {"__p": F.lit(1).cast("long")}, alone=True, before=True).withColumn("__p", F.coalesce("__p", F.lit(0)))
    return auroc(rows.withColumn("band", band.cast("int")), label, score, ["band"])


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Spearman r of x and y with the ranks of z taken out of both by regression.

    Rows with a null in any are passed over; null if a column is constant or a function of z's ranks.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c, name in ((x, "__rx"), (y, "__ry"), (z, "__rz")):
        rows = avg_rank(rows, c, name=name)
    r = rows.agg(*[pearson(a, b).alias(n) for n, a, b in (("xy", "__rx", "__ry"), ("xz", "__rx", "__rz"), ("yz", "__ry", "__rz"))])
    below = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return r.select(F.when(below > 0, (F.col("xy") - F.col("xz") * F.col("yz")) / below).alias("partial_spearman"))


def residual_spearman(df: DataFrame, x: str, y: str, covariates: Sequence[str]) -> DataFrame:
    """(spearman, n): Spearman r of what is left of x and y after a linear fit on the covariates.

    The normal equations are sums over one pass, a row of (covariates + 3)^2 numbers at most.
    """
    names = ["__one", *covariates]
    rows = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (x, y, *covariates)])).withColumn("__one", F.lit(1.0))
    pairs = [(a, b) for a in names for b in [*names, x, y]]
    sums = rows.agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).first()
    if sums[0] is None:
        return df.sparkSession.createDataFrame([(None, 0)], "spearman double, n long")
    table = np.array(list(sums), float).reshape(len(names), len(names) + 2)
    fits = np.linalg.lstsq(table[:, :-2], table[:, -2:], rcond=None)[0]
    left = lambda c, w: F.col(c) - reduce(Column.__add__, [F.col(n) * float(v) for n, v in zip(names, w)])
    return spearman(rows.select(left(x, fits[:, 0]).alias("__x"), left(y, fits[:, 1]).alias("__y")), "__x", "__y")


def spearman_screen(df: DataFrame, target: str, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(feature, rho, n, p, q, rejected): every feature against a continuous target; p by Student's t on n - 2."""
    rows = df.select(F.col(target).cast("double").alias("__t"), *[F.col(f).cast("double") for f in features]).unpivot("__t", list(features), "feature", "v")
    rho = spearman(rows, "v", "__t", ["feature"]).withColumnRenamed("spearman", "rho")
    t = F.abs("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    p = F.when((F.col("n") > 2) & (F.abs("rho") < 1), F.least(2 * student_tail("__t", "__df"), F.lit(1.0))).when(F.abs("rho") >= 1, 0.0)
    tested = rho.withColumns({"__t": t, "__df": (F.col("n") - 2).cast("double")}).withColumn("p", p).drop("__t", "__df")
    return bh_fdr(tested, "p", alpha=alpha)


def univariate_screen(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, auroc, effect, direction, p, q): every feature against one label in one job. p is Mann-Whitney's;
    ``spearman_screen`` takes a continuous target."""
    rows = df.select(F.col(label).cast("int").alias("y"), *[F.col(f).cast("double") for f in features]).unpivot("y", list(features), "feature", "v").where("v is not null")
    auc = auroc(rows, "y", "v", ["feature"])
    test = mann_whitney(rows.withColumn("one", F.col("y") > 0), "one", "v", ["feature"]).select("feature", "p")
    out = auc.join(test, "feature", "left").withColumn("effect", F.abs(F.col("auroc") - 0.5) * 2).withColumn("direction", F.when(F.col("auroc") >= 0.5, "higher").otherwise("lower"))
    return bh_fdr(out, "p").select("feature", "auroc", "effect", "direction", "p", "q")


def set_permutation(df: DataFrame, member: str, value: str, key: str, draws: int, seed: int = 0) -> DataFrame:
    """(observed, ge, p): mean of the member set against ``draws`` hash-ranked subsets of its size.

    Rows with a null value are passed over; keys must name rows; without members there is nothing to observe and p is
    1 / (draws + 1).
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("__k"), F.col(member).cast("boolean").alias("__m"), F.col(value).alias("__v"))
    seen = rows.where("__m").agg(F.avg("__v").alias("observed"), F.count("*").alias("k"))
    chosen = smallest_hashes(rows, "__k", seen.select("k"), draws, seed)
    deals = chosen.join(rows.select("__k", "__v"), "__k").crossJoin(F.broadcast(seen.select("observed")))
    each = deals.groupBy("__r", "observed").agg(F.avg("__v").alias("s"))
    out = each.groupBy("observed").agg(F.sum((F.col("s") >= F.col("observed") - 1e-12).cast("int")).alias("ge"))
    return out.withColumn("p", (F.col("ge") + 1) / (draws + 1))


def threshold_sweep(df: DataFrame, value: str, score: str, cuts: Sequence[float], min_count: int = 5) -> DataFrame:
    """(cut, n_pos, n_neg, auroc) of ``score`` for the label value > cut; null where a class has under ``min_count`` rows."""
    table = F.broadcast(df.sparkSession.createDataFrame([(float(c),) for c in cuts], "cut double"))
    rows = df.select(F.col(value).alias("v"), F.col(score).alias("s")).crossJoin(table).withColumn("y", (F.col("v") > F.col("cut")).cast("int"))
    out = auroc(rows, "y", "s", ["cut"])
    return out.select("cut", "n_pos", "n_neg", F.when((F.col("n_pos") >= min_count) & (F.col("n_neg") >= min_count), F.col("auroc")).alias("auroc"))


#: Rows that a task draws all replicates of.
ROWS_A_TASK = 20_000


def threshold_sweep_ci(df: DataFrame, value: str, score: str, cuts: Sequence[float], key: str, draws: int, seed: int = 0, min_count: int = 5, level: float = 0.95) -> DataFrame:
    """``threshold_sweep`` with (lo, hi) of the AUC by Poisson bootstrap of rows; replicates without both classes are passed over."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(float(c),) for c in cuts], "cut double"))
    turns = F.broadcast(spark.range(draws).withColumnRenamed("id", "__r"))
    rows = df.select(F.col(key).cast("string").alias("__k"), F.col(value).alias("v"), F.col(score).alias("s")).where("v is not null and s is not null")
    tasks = -(-rows.count() // ROWS_A_TASK)  # a small file makes many draws
    rows = (rows.repartition(tasks) if tasks > 1 else rows).crossJoin(turns)
    rows = rows.withColumn("__w", poisson_weight(seed, F.col("__r").cast("string"), F.col("__k"))).where("__w > 0").crossJoin(table)
    up = (F.col("v") > F.col("cut")).cast("int")
    cells = rows.groupBy("cut", "__r", "s").agg(F.sum(F.col("__w") * up).alias("p"), F.sum(F.col("__w") * (1 - up)).alias("q"))
    cells = written(cells, "cells")  # counting and ordering would draw anew
    cells = running(cells, ["cut", "__r"], ["s"], {"below": F.col("q")}, alone=True, before=True)
    each = cells.withColumn("won", F.col("p") * (F.coalesce("below", F.lit(0)) + F.col("q") / 2)).groupBy("cut", "__r").agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))
    ends = each.groupBy("cut").agg(F.percentile("auc", (1 - level) / 2).alias("lo"), F.percentile("auc", (1 + level) / 2).alias("hi"))
    return threshold_sweep(df, value, score, cuts, min_count).join(ends, "cut", "left").select("cut", "n_pos", "n_neg", "auroc", *[F.when(F.col("auroc").isNotNull(), F.col(c)).alias(c) for c in ("lo", "hi")])
