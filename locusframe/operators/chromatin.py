"""Chromatin marks: states, features, residuals and matched contrasts."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.tails import fisher_greater, normal_tail
from locusframe.operators.intervals import looked_up, nearest_distance, window_mean, window_means
from locusframe.operators.iterate import written
from locusframe.operators.scan import running
from locusframe.operators.stats import mann_whitney, smallest_hashes, value_ranks

#: Marks of active and of repressed chromatin, all marks that states use, and the levels called high and low.
ACTIVE = ("H3K27ac", "H3K4me1", "H3K4me3", "H3K9ac")
REPRESSIVE = ("H3K27me3", "H3K9me3")
MARKS = ("H3K4me3", "H3K4me1", "H3K27ac", "H3K27me3", "H3K9me3", "H3K36me3", "H3K9ac", "CTCF")
HIGH, LOW = 2.0, 0.8
TARGET_CLASS = {"H3K27AC": "active_enhancer_promoter", "H3K4ME1": "enhancer", "H3K4ME3": "promoter", "H3K27ME3": "repressed", "H3K9ME3": "heterochromatin", "H3K36ME3": "transcribed"}


def enrichment(df: DataFrame, keys: Sequence[str] = ("mark", "locus")) -> DataFrame:
    """(mark, locus, level): mean over the replicate's background mean, averaged over replicates. Background rows: locus null."""
    ground = df.where(F.col("locus").isNull()).groupBy("mark", "replicate").agg(F.avg("value").alias("__g"))
    one = df.where(F.col("locus").isNotNull()).groupBy("mark", "replicate", "locus").agg(F.avg("value").alias("v")).join(ground, ["mark", "replicate"])
    return one.where("__g > 0").groupBy(*keys).agg(F.avg(F.col("v") / F.col("__g")).alias("level"))


def per_million(mean: Column, depth: Column) -> Column:
    """Mean per million reads; 0 where the depth is 0 or null; a null mean is null."""
    return F.when(depth > 0, mean / (depth / 1e6)).otherwise(0.0)


def classify_mark(c: str) -> Column:
    """Kind of a mark by its name, without regard to case; null, empty and ``?`` are unknown, any other name is a factor."""
    t = F.upper(F.coalesce(F.col(c), F.lit("")))
    chain = F.when(t.isin("", "?"), "unknown")
    for name, kind in TARGET_CLASS.items():
        chain = chain.when(t == name, kind)
    return chain.otherwise("tf")


def mark_levels(df: DataFrame, key: str) -> DataFrame:
    """A row per key with a column per mark; absent marks are 0."""
    return df.groupBy(key).pivot("mark", list(MARKS)).agg(F.max("level")).na.fill(0.0, list(MARKS))


def chromatin_state(high: float = HIGH, low: float = LOW) -> Column:
    """The state of a row of mark levels: the first rule that holds."""
    c = F.col
    rules = (
        ((c("H3K4me3") > high) & (c("H3K27me3") > high), "bivalent_poised"), ((c("H3K4me3") > high) & (c("H3K27ac") > low), "active_promoter"),
        ((c("H3K4me1") > high) & (c("H3K27ac") > high) & (c("H3K4me3") < high), "active_enhancer"), ((c("H3K4me1") > high) & (c("H3K27ac") <= low), "poised_enhancer"),
        (c("H3K27me3") > high, "polycomb_repressed"), (c("H3K9me3") > high, "heterochromatin"), (c("H3K36me3") > high, "transcribed"), (c("CTCF") > high, "insulator"))
    out = F
    for test, name in rules:
        out = out.when(test, name)
    return out.otherwise("quiescent")


def chromatin_features(df: DataFrame) -> DataFrame:
    """``df`` with activity and state from one column per mark. A null mark makes what it enters null."""
    mean = lambda ms: sum((F.col(m) for m in ms), F.lit(0.0)) / len(ms)
    out = df.withColumn("active_signal", mean(ACTIVE)).withColumn("repressive_signal", mean(REPRESSIVE)).withColumn("bivalency", F.least("H3K4me3", "H3K27me3"))
    score = (F.col("active_signal") - F.col("repressive_signal")) / (F.col("active_signal") + F.col("repressive_signal") + 1e-6)
    out = out.withColumn("activity_score", F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0)))
    return out.withColumn("activity_unit", (F.col("activity_score") + 1) / 2).withColumn("state", chromatin_state())


def summit_features(c: str) -> Column:
    """struct(summit, summit_pos, fwhm, bimodality) of a coverage array; an empty or flat-zero one has position -1."""
    v = F.col(c)
    n, top = F.size(v), F.array_max(v)
    above = F.filter(F.transform(v, lambda x, i: F.when(x >= top / 2, i)), lambda i: i.isNotNull())
    mid, tenth = F.floor(n / 2).cast("int"), F.floor(n / 10).cast("int")
    left, right = F.array_max(F.slice(v, F.lit(1), mid)), F.array_max(F.slice(v, mid + 1, n))
    core = F.slice(v, F.greatest(mid - tenth, F.lit(0)) + 1, mid + tenth - F.greatest(mid - tenth, F.lit(0)))
    center = F.when(n > 10, F.aggregate(core, F.lit(0.0), lambda s, x: s + x) / F.size(core)).otherwise(top)
    flat = v.isNull() | (n == 0) | (top == 0)
    lobe = F.least(F.coalesce(left, F.lit(0.0)), F.coalesce(right, F.lit(0.0)))
    return F.struct(
        F.when(flat, 0.0).otherwise(top).alias("summit"), F.when(flat, -1).otherwise((F.array_position(v, top) - 1).cast("int")).alias("summit_pos"),
        F.when(flat, 0).otherwise(F.array_max(above) - F.array_min(above)).alias("fwhm"), F.when(flat | (center <= 0), 0.0).otherwise(lobe / (center + 1e-6)).alias("bimodality"))


def log2_residual(loci: DataFrame, case: DataFrame, control: DataFrame, key: str, pseudo: float = 1.0, replicate: str | None = None) -> DataFrame:
    """``loci`` with case, control and residual = log2((case + pseudo) / (control + pseudo)); control replicates are averaged first."""
    names = [r[0] for r in control.select(replicate).distinct().orderBy(replicate).collect()] if replicate else [None]  # replicates of one control: a few
    place = lambda rows, side: rows.select("chrom", "start_pos", "end_pos", "value", F.lit(side).alias("__side"))
    both = place(case, -1)
    for n, r in enumerate(names):
        both = both.unionByName(place(control.where(F.col(replicate) == r) if replicate else control, n))
    out = window_means(loci, both, key, {f"__m{n}": F.col("__side") == n for n in range(-1, len(names))})
    means = [F.col(f"__m{n}") for n in range(len(names))]
    level = F.try_divide(reduce(Column.__add__, [F.coalesce(m, F.lit(0.0)) for m in means]), reduce(Column.__add__, [m.isNotNull().cast("int") for m in means])) if replicate else means[0]
    out = out.withColumns({"case": F.col("__m-1"), "control": level}).drop("__m-1", *[f"__m{n}" for n in range(len(names))])
    return out.withColumn("residual", F.log2((F.col("case") + pseudo) / (F.col("control") + pseudo)))


def set_contrast(df: DataFrame, target: str, value: str, part: Sequence[str] = ()) -> DataFrame:
    """(part, target_mean, background_mean, target_up, background_up, u, p): rank test that targets are greater.

    Rows with a null value are passed over; without both groups u and p are null.
    """
    t = F.col(target)
    mean = lambda w, c: F.avg(F.when(w, c))
    v = F.col(value)
    out = df.where(v.isNotNull()).groupBy(*part).agg(
        mean(t, v).alias("target_mean"), mean(~t, v).alias("background_mean"), mean(t, (v > 0).cast("double")).alias("target_up"), mean(~t, (v > 0).cast("double")).alias("background_up"))
    test = mann_whitney(df, target, value, part, "greater").select(*part, "u", "p")
    return out.join(test, list(part), "left") if part else out.crossJoin(test)


def _nearest(state: DataFrame, of: str, part: Sequence[str]) -> DataFrame:
    """``state`` with ``near_<of>``: the nearest score where ``of`` is over 0, the lower of two."""
    some = F.when(F.col(of) > 0, F.col("s"))
    out = running(state, part, ["s"], {"__lo": some}, "max", alone=True)
    out = running(out, part, [F.desc("s")], {"__hi": some}, "min", alone=True)
    near = F.when(F.col("__hi").isNull() | (F.col("s") - F.col("__lo") <= F.col("__hi") - F.col("s")), F.col("__lo")).otherwise(F.col("__hi"))
    return out.withColumn(f"near_{of}", near).drop("__lo", "__hi")


def _closest_first(rows: pd.DataFrame) -> pd.DataFrame:
    """All matches of one segment, in order of (gap, target score, match score), between distinct scores.

    Of scores with open places or free rows the closest pair is always neighbours, so a heap of neighbours in a linked
    list yields it: a score that has given or taken all leaves the list and its neighbours become a pair.
    """
    rows = rows.sort_values("s")
    s, need, free = (rows[c].tolist() for c in ("s", "need", "free"))
    asked, given, width = rows["asked"].tolist(), rows["given"].tolist(), float(rows["width"].iloc[0])
    n = len(s)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, float, float, int, int]] = []

    def pair(i: int, j: int) -> None:
        for t, b in ((i, j), (j, i)) if i != j else ((i, i),):
            if need[t] > 0 and free[b] > 0 and abs(s[t] - s[b]) <= width:
                heapq.heappush(heap, (abs(s[t] - s[b]), s[t], s[b], t, b))

    for k in range(n):
        pair(k, k)
        if k:
            pair(k - 1, k)
    found = []
    while heap:
        _, ts, bs, t, b = heapq.heappop(heap)
        units = min(need[t], free[b])
        if not units:
            continue
        found.append((ts, bs, asked[t], given[b], units))
        need[t], free[b], asked[t], given[b] = need[t] - units, free[b] - units, asked[t] + units, given[b] + units
        for k in {t, b}:
            if not need[k] and not free[k]:
                i, j = before[k], after[k]
                if i >= 0:
                    after[i] = j
                if j >= 0:
                    before[j] = i
                if i >= 0 and j >= 0:
                    pair(i, j)
    return pd.DataFrame(found, columns=["ts", "bs", "asked", "given", "n"])


#: Distinct scores that are matched in one task.
SEGMENT = 1_000_000


def caliper_match(df: DataFrame, target: str, score: str, key: str, caliper: float | Column, m: int = 3, part: Sequence[str] = (), segment: int | None = None) -> DataFrame:
    """(part, target, match, gap): up to m unused background rows of each target within caliper x spread, closest pairs first.

    As if all pairs were walked by (gap, target score, match score, target, match) and each taken whose row is free and
    whose target is short of m, until no pair is left. Order-free, so a contested row may go to another target than a walk
    over targets would give it. Distinct scores are cut into segments where neighbours are further apart than the caliper;
    a segment is matched by itself, in one task up to SEGMENT scores. Scores of a larger one that are nearest to each other
    are matched first, all over it at once, the k-th open place of one with the k-th free row of the other; scores that
    have nothing left drop out and the rest is cut again. Rows without a score are passed over; with ``part``, spread and
    matches are a part's own and ``caliper`` may be a column of it.
    """
    part = list(part)
    c = caliper if isinstance(caliper, Column) else F.lit(float(caliper))
    rows = df.where(F.col(target).isNotNull()).select(*part, F.col(key).alias("key"), F.col(target).alias("t"), F.col(score).cast("double").alias("s"), c.alias("c")).where("s is not null and not isnan(s)")
    spread = rows.groupBy(*part).agg(F.greatest(F.max("c") * F.stddev_pop("s"), F.lit(1e-12)).alias("width"))
    counts = rows.groupBy(*part, "s").agg((m * F.count_if("t")).alias("need"), F.count_if(~F.col("t")).alias("free"))
    nil = F.lit(0).cast("long")
    state = written((counts.join(spread, part) if part else counts.crossJoin(F.broadcast(spread))).withColumns({"asked": nil, "given": nil}), "caliper")
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    fields = "".join(f"`{p}` {kinds[p]}, " for p in part)
    rounds = []
    while True:
        live = state.where("need > 0 or free > 0")
        cut = running(live, part, ["s"], {"__was": F.col("s")}, "max", alone=True, before=True)
        fresh = F.when(F.col("__was").isNull() | (F.col("s") - F.col("__was") > F.col("width")), F.col("s"))
        cut = running(cut, part, ["s"], {"seg": fresh}, "max", alone=True).drop("__was")
        sizes = cut.groupBy(*part, "seg").agg(F.count("*").alias("__n"), F.sum("need").alias("__need"), F.sum("free").alias("__free")).where("__need > 0 and __free > 0").drop("__need", "__free")
        cut = written(cut.join(sizes, [*part, "seg"]), "caliper")
        small = F.col("__n") <= (segment or SEGMENT)

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            out = _closest_first(rows)
            return out.assign(**{p: rows[p].iloc[0] for p in part})[[*part, *out.columns]]

        rounds.append(written(cut.where(small).groupBy(*part, "seg").applyInPandas(whole, fields + "ts double, bs double, asked long, given long, n long"), "caliper"))
        state = cut.where(~small).drop("seg", "__n")
        if state.isEmpty():
            break
        seen = _nearest(_nearest(state, "free", part), "need", part)
        asks = seen.where((F.col("need") > 0) & (F.abs(F.col("s") - F.col("near_free")) <= F.col("width"))).select(*part, F.col("s").alias("ts"), F.col("near_free").alias("bs"), "need", "asked")
        gives = seen.where("free > 0").select(*part, F.col("near_need").alias("ts"), F.col("s").alias("bs"), "free", "given")
        block = written(asks.join(gives, [*part, "ts", "bs"]).select(*part, "ts", "bs", "asked", "given", F.least("need", "free").alias("n")), "caliper")
        if block.isEmpty():
            break
        rounds.append(block)
        state = state.join(block.select(*part, F.col("ts").alias("s"), F.col("n").alias("a")), [*part, "s"], "left").join(block.select(*part, F.col("bs").alias("s"), F.col("n").alias("b")), [*part, "s"], "left")
        a, b = F.coalesce("a", nil), F.coalesce("b", nil)
        state = written(state.select(*part, "s", (F.col("need") - a).alias("need"), (F.col("free") - b).alias("free"), "width", (F.col("asked") + a).alias("asked"), (F.col("given") + b).alias("given")), "caliper")
    units = reduce(DataFrame.unionByName, rounds).withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    units = units.select(*part, "ts", "bs", (F.col("asked") + F.col("k")).alias("place"), (F.col("given") + F.col("k")).alias("row"))
    one = F.lit(1).cast("long")
    t = running(rows.where("t").select(*part, "s", "key"), [*part, "s"], ["key"], {"i": one}, alone=True)
    t = t.select(*part, F.col("key").alias("target"), F.col("s").alias("ts"), F.explode(F.array(*[(F.col("i") * m - m + k).cast("long") for k in range(m)])).alias("place"))
    b = running(rows.where("not t").select(*part, "s", "key"), [*part, "s"], ["key"], {"i": one}, alone=True).select(*part, F.col("key").alias("match"), F.col("s").alias("bs"), (F.col("i") - 1).alias("row"))
    return units.join(t, [*part, "ts", "place"]).join(b, [*part, "bs", "row"]).select(*part, "target", "match", F.abs(F.col("ts") - F.col("bs")).alias("gap"))


def sweep(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """``df`` once per setting, so one job answers for all: group by ``name`` afterwards."""
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(float(v),) for v in values], f"{name} double")))


def signal_means(loci: DataFrame, tracks: DataFrame, widths: Sequence[int], key: str, pos: str = "tss", value: str = "value") -> DataFrame:
    """(key, width, track, mean, n): plain mean of a track's records that overlap pos - width .. pos + width, for all widths.

    An index of running totals: what overlaps a window is what starts before its end less what ends up to its start, so a
    window of any width is two look-ups and a subtraction, in stretches of bases. Values are taken from their mean first, so that sums stay small. ``tracks`` has a
    column ``track``; null or NaN values, and records without a place or of no length, are skipped; a window without
    records has a null mean; loci that share a key each have their own rows; loci without a place have none.
    """
    if min(widths) < 1:
        raise ValueError("a width is one base or more")
    records = tracks.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col("start_pos") < F.col("end_pos")) & F.col("track").isNotNull()).select("track", "chrom", "start_pos", "end_pos", F.col(value).cast("double").alias("v"))
    middle = records.agg(F.avg("v")).first()[0] or 0.0
    names = records.select("track").distinct()
    asks = sweep(loci.where(F.col("chrom").isNotNull() & F.col(pos).isNotNull()).select(F.col(key).alias("__key"), "chrom", F.col(pos).alias("__pos")), "width", widths).crossJoin(names)
    asks = asks.withColumn("width", F.col("width").cast("long")).withColumn("start_pos", F.col("__pos") - F.col("width")).withColumn("end_pos", F.col("__pos") + F.col("width"))
    found = looked_up(asks, records, {"n": F.lit(1).cast("long"), "v": F.col("v") - middle}, ["track", "chrom"])
    inside = lambda c: F.col(f"hi_{c}_s") - F.col(f"lo_{c}_e")
    return found.select(F.col("__key").alias(key), "width", "track", F.when(inside("n") > 0, inside("v") / inside("n") + middle).alias("mean"), inside("n").alias("n"))


def residual_sweep(loci: DataFrame, case: DataFrame, control: DataFrame, key: str, target: str, widths: Sequence[int], pseudos: Sequence[float], draws: int, seed: int = 0, pos: str = "tss") -> DataFrame:
    """A row per window width and pseudo-count: n, n_target, target_mean, background_mean, fold, u, p, set_ge, set_p.

    The residual is log2((case + pseudo) / (control + pseudo)) of the means within the width; loci without both are passed
    over, and so are rows whose ``target`` is null. p is the rank test that targets are greater; set_p the share of
    ``draws`` background sets of the targets' number, chosen by hash, whose mean is at least theirs. Means come from
    running totals, so residuals are rounded to nine digits: windows of equal records tie. ``loci`` has a row a key.
    """
    tracks = case.withColumn("track", F.lit("case")).unionByName(control.withColumn("track", F.lit("control")), allowMissingColumns=True)
    means = signal_means(loci, tracks, widths, key, pos)
    means = means.groupBy(key, "width").agg(*[F.max(F.when(F.col("track") == t, F.col("mean"))).alias(t) for t in ("case", "control")]).dropna()
    flags = loci.select(key, F.col(target).cast("boolean").alias("__t")).where("__t is not null")
    rows = sweep(means.join(flags, key), "pseudo", pseudos).withColumn("residual", F.round(F.log2((F.col("case") + F.col("pseudo")) / (F.col("control") + F.col("pseudo"))), 9))
    rows = written(rows.select(key, "width", "pseudo", "__t", "residual"), "residuals")
    part = ["width", "pseudo"]
    t, v = F.col("__t"), F.col("residual")
    out = rows.groupBy(*part).agg(F.count("*").alias("n"), F.count_if(t).alias("n_target"), F.avg(F.when(t, v)).alias("target_mean"), F.avg(F.when(~t, v)).alias("background_mean"))
    out = written(out.withColumn("fold", F.pow(F.lit(2.0), F.col("target_mean"))), "sweep")
    test = mann_whitney(rows, "__t", "residual", part, "greater").select(*part, "u", "p")
    chosen = smallest_hashes(rows.where(~t), key, out.select(*part, F.col("n_target").alias("k")), draws, seed, part=part)
    each = chosen.join(rows.select(key, *part, "residual"), [key, *part]).groupBy(*part, "__r").agg(F.avg("residual").alias("__m"))
    hits = each.join(out.select(*part, "target_mean"), part).groupBy(*part).agg(F.count_if(F.col("__m") >= F.col("target_mean") - 1e-12).alias("set_ge"))
    return out.join(test, part, "left").join(hits, part, "left").withColumn("set_p", F.col("set_ge") / draws)


def caliper_sweep(df: DataFrame, target: str, value: str, score: str, key: str, calipers: Sequence[float], m: int = 3) -> DataFrame:
    """A row per caliper: n_matched, matched_mean, u, p of all targets' ``value`` against their matches', greater. All
    calipers are matched side by side. A caliper without a match has n_matched 0 and no test."""
    rows = sweep(df.where(F.col(target).isNotNull() & F.col(value).isNotNull()).select(key, target, value, score), "caliper", calipers)
    pairs = caliper_match(rows, target, score, key, F.col("caliper"), m, ["caliper"])
    matched = written(pairs.select("caliper", F.col("match").alias(key)).join(df.select(key, value), key).select("caliper", value, F.lit(False).alias("__t")), "matched")
    both = matched.unionByName(rows.where(F.col(target)).select("caliper", value, F.lit(True).alias("__t")))
    out = both.groupBy("caliper").agg(F.count_if(~F.col("__t")).alias("n_matched"), F.avg(F.when(~F.col("__t"), F.col(value))).alias("matched_mean"))
    return out.join(mann_whitney(both, "__t", value, ["caliper"], "greater").select("caliper", "u", "p"), "caliper", "left")


def leave_one_out(df: DataFrame, target: str, value: str, key: str) -> DataFrame:
    """(dropped, mean, u, p, worst) of the rank test that targets are greater, with each target left out; ``worst`` is the
    largest p of all.

    U counts wins of targets over background, so leaving one out subtracts its wins, and ties lose it from its value: both
    come from value counts, and no row is copied. Nulls are passed over; with one target or no background p is null.
    """
    rows = df.where(F.col(target).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("dropped"), F.col(target).cast("boolean").alias("__t"), F.col(value).alias("__v"))
    ranks = value_ranks(rows.withColumn("__b", (~F.col("__t")).cast("long")), "__v", ["__b"])
    cubes = lambda c: c * c * c - c
    n = F.col("n").cast("double")
    wins = F.col("before___b") + F.col("__b") / 2
    ranks = written(ranks.select("__v", n.alias("n"), (n - F.col("__b")).alias("__a"), wins.alias("wins")), "values")
    all_ = ranks.agg(F.sum("n").alias("__n"), F.sum("__a").alias("__n1"), F.sum(F.col("__a") * F.col("wins")).alias("__u"), F.sum(F.col("__a") * F.col("__v")).alias("__s"), F.sum(cubes(F.col("n"))).alias("__ties"))
    each = rows.where("__t").join(ranks, "__v").crossJoin(F.broadcast(all_))
    n1, n2 = F.col("__n1") - 1, F.col("__n") - F.col("__n1")
    total = n1 + n2
    ties = F.col("__ties") - cubes(F.col("n")) + cubes(F.col("n") - 1)
    spread = F.sqrt(F.greatest(n1 * n2 / 12 * ((total + 1) - F.coalesce(F.try_divide(ties, total * (total - 1)), F.lit(0.0))), F.lit(0.0)))
    out = each.select("dropped", F.try_divide(F.col("__s") - F.col("__v"), n1).alias("mean"), (F.col("__u") - F.col("wins")).alias("u"), n1.alias("__n1"), n2.alias("__n2"), spread.alias("__sd"))
    z = F.when(F.col("__sd") > 0, (F.col("u") - F.col("__n1") * F.col("__n2") / 2 - 0.5) / F.col("__sd")).when((F.col("__n1") > 0) & (F.col("__n2") > 0), 0.0)
    out = written(out.withColumn("__z", z).select("dropped", "mean", "u", normal_tail("__z").alias("p")), "left-out")
    return out.crossJoin(F.broadcast(out.agg(F.max("p").alias("worst"))))


def genome3d_features(loci: DataFrame, compartments: DataFrame, insulation: DataFrame, boundaries: DataFrame, key: str) -> DataFrame:
    """``loci`` with eigenvector, insulation, distance to the nearest boundary and compartment. Loci that no record
    overlaps have null means and a null compartment; rows without a key have no row."""
    a = window_mean(loci, compartments, key).select(key, F.col("mean").alias("eigenvector"))
    b = window_mean(loci, insulation, key).select(key, F.col("mean").alias("insulation"))
    c = nearest_distance(loci.withColumn("pos", F.col("tss")), boundaries).select(key, "distance")
    out = loci.join(a, key).join(b, key).join(c, key)
    return out.withColumn("compartment", F.when(F.col("eigenvector") > 0, "A").when(F.col("eigenvector") < 0, "B"))


def fisher_enrichment(df: DataFrame, target: str, flag: str) -> DataFrame:
    """One row: the 2 x 2 counts, odds ratio (null if undefined) and P of as many flagged targets or more."""
    n = lambda t, f: F.coalesce(F.sum((t & f).cast("long")), F.lit(0))
    t, f = F.col(target), F.col(flag)
    out = df.agg(n(t, f).alias("a"), n(t, ~f).alias("b"), n(~t, f).alias("c"), n(~t, ~f).alias("d"))
    return out.withColumn("odds_ratio", F.when(F.col("b") * F.col("c") > 0, F.col("a") * F.col("d") / (F.col("b") * F.col("c")))).withColumn("p", fisher_greater("a", "b", "c", "d"))
