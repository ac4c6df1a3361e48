"""Interval algebra on (chrom, start_pos, end_pos), half-open and 0-based. Joins meet in bins, so they are equi-joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.iterate import written
from locusframe.operators.scan import carried, sliced

BIN = 8192


def choose_bin(df: DataFrame, lo: str = "start_pos", hi: str = "end_pos") -> int:
    """A bin that nine in ten intervals fit in, so few rows are repeated."""
    width = df.agg(F.percentile_approx(F.col(hi) - F.col(lo), 0.9)).first()[0] or 1
    return max(256, 1 << int(width).bit_length())


def _binned(df: DataFrame, lo: str, hi: str, size: int, name: str) -> DataFrame:
    first, last = F.expr(f"`{lo}` div {size}"), F.expr(f"greatest(`{hi}` - 1, `{lo}`) div {size}")
    return df.withColumn(f"{name}_first", first).withColumn("bin", F.explode(F.sequence(first, last)))


def apart(df: DataFrame) -> DataFrame:
    """``df``, to be joined where both sides are shuffled. Spark takes a table that grows as the input does for small, by the
    compressed columns that it is made from, and would gather its rows in the driver to broadcast them."""
    return df.hint("merge")


def _prefixed(b: DataFrame, prefix: str = "b_") -> DataFrame:
    return b.select(*[F.col(c).alias(f"{prefix}{c}") for c in b.columns])


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", size: int = BIN) -> DataFrame:
    """Pairs with a.start < b.end and a.end > b.start on one chromosome; columns of ``b`` get the prefix ``b_``.

    A pair meets once: in the first bin that both reach. ``how`` may be inner, left, left_semi or left_anti; for the last
    three rows of ``a`` are told apart by all their columns, nulls included. Long intervals take a row a bin;
    ``choose_bin`` keeps that small. Rows with a null chromosome or end overlap nothing; repeated rows each count.
    """
    right = _binned(_prefixed(b), "b_start_pos", "b_end_pos", size, "__b").withColumnRenamed("bin", "__bbin")
    left = _binned(a, "start_pos", "end_pos", size, "__a")
    meet = (
        (F.col("chrom") == F.col("b_chrom")) & (F.col("bin") == F.col("__bbin"))
        & (F.col("start_pos") < F.col("b_end_pos")) & (F.col("end_pos") > F.col("b_start_pos"))
        & (F.col("bin") == F.greatest("__a_first", "__b_first"))
    )
    pairs = left.join(apart(right), meet).drop("bin", "__bbin", "__a_first", "__b_first")
    if how == "inner":
        return pairs
    met = pairs.select(*[F.col(c).alias(f"__met_{c}") for c in a.columns]).distinct()
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__met_{c}")) for c in a.columns])
    if how in ("left_semi", "left_anti"):
        return a.join(met, same, how)
    return pairs.unionByName(a.join(met, same, "left_anti"), allowMissingColumns=True)


#: Rows of both tables a task; rows of the first that meet a bin in one task; pairs that leave a task at once.
MEETING, CROWDED, PAIRS = 50_000, 20_000, 1_000_000


def overlap_pairs(a: DataFrame, b: DataFrame, key: str, other: str, size: int = BIN) -> DataFrame:
    """(key, other): the keys of each pair of ``overlap_join``, which comes once for each pair of rows.

    In a bin the rows of ``b`` lie by start, so those that a row of ``a`` may meet are a range: pairs are read off ranges on
    arrays, and what is compared grows as what comes out does. A task holds a bin's rows of ``b`` and PAIRS pairs. A bin with
    more than CROWDED rows of ``a`` is dealt to several tasks.
    """
    place = ["chrom", "bin"]

    def rows(df: DataFrame, k: str, name: str) -> DataFrame:
        whole = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("chrom", "start_pos", "end_pos")]))
        whole = whole.select(F.col(k).alias(name), "chrom", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))
        return _binned(whole, "start_pos", "end_pos", size, "__x").withColumn("__fresh", F.col("__x_first") == F.col("bin")).drop("__x_first")

    mine, theirs = rows(a, key, "__a"), rows(b, other, "__b")
    crowds = F.broadcast(mine.groupBy(*place).agg(F.ceil(F.count("*") / CROWDED).cast("int").alias("__parts")).where("__parts > 1"))
    parts = F.coalesce("__parts", F.lit(1))
    mine = mine.join(crowds, place, "left").withColumn("__part", F.pmod(F.xxhash64("__a", "start_pos", "end_pos"), parts).cast("int")).withColumn("__asks", F.lit(True))
    theirs = theirs.join(crowds, place, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("__asks", F.lit(False))
    tasks = max(1, -(-(a.count() + b.count()) // MEETING))
    groups = [*place, "__part"]
    met = theirs.drop("__parts").unionByName(mine.drop("__parts"), allowMissingColumns=True)
    met = met.repartition(tasks, *groups).sortWithinPartitions(*groups, "__asks", "start_pos")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lies, ready, total = None, [], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            differs = np.zeros(batch.num_rows - 1, bool)
            for g in groups:
                differs |= pc.not_equal(batch[g][1:], batch[g][:-1]).to_numpy(zero_copy_only=False)
            asks = batch["__asks"].to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(differs) + 1, batch.num_rows]
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                here = tuple(batch[g][i].as_py() for g in groups)
                if here != now:
                    now, held, lies = here, [], None
                first = i + int(np.searchsorted(asks[i:j], True))  # rows of b come first, by start
                if first > i:
                    held.append(batch.slice(i, first - i))
                if first == j or not held:
                    continue
                if lies is None:
                    lies = [pa.concat_arrays([h[c] for h in held]) for c in ("__b", "start_pos", "end_pos", "__fresh")]
                    lies = [lies[0], *[c.to_numpy(zero_copy_only=False) for c in lies[1:]]]
                for pair in ranges(batch.slice(first, j - first), *lies):
                    ready.append(pair)
                    total += len(pair[0])
                    if total >= PAIRS:
                        yield made(ready)
                        ready, total = [], 0
        if ready:
            yield made(ready)

    def made(ready: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*ready)], ["__a", "__b"])

    def ranges(asked: pa.RecordBatch, keys: pa.Array, start: np.ndarray, end: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
        lo, hi = (asked[c].to_numpy() for c in ("start_pos", "end_pos"))
        # A pair counts in the first bin that both reach, so a row that comes from an earlier bin meets only those that begin here.
        least = np.where(asked["__fresh"].to_numpy(zero_copy_only=False), 0, int((~fresh).sum()))
        inside, past = np.searchsorted(start, lo), np.searchsorted(start, hi)
        inside = np.where((end <= start).any(), len(start), inside)  # rows of no length are all looked at
        reach = np.searchsorted(start, lo - int((end - start).max()), side="right")
        for begin, stop, sure in ((np.maximum(reach, least), np.minimum(inside, past), False), (np.maximum(inside, least), past, True)):
            counts = np.maximum(stop - begin, 0)
            upto = np.r_[0, np.cumsum(counts)]
            k = 0
            while k < len(counts):
                n = max(k + 1, int(np.searchsorted(upto, upto[k] + PAIRS, side="right")) - 1)
                who = np.repeat(np.arange(k, n), counts[k:n])
                at = np.arange(upto[k], upto[n]) - np.repeat(upto[k:n] - begin[k:n], counts[k:n])
                if not sure:
                    over = end[at] > lo[who]
                    who, at = who[over], at[over]
                if len(at):
                    yield asked["__a"].take(pa.array(who)), keys.take(pa.array(at))
                k = n

    kinds = [f"{c} {df.schema[k].dataType.simpleString()}" for c, df, k in (("__a", a, key), ("__b", b, other))]
    return met.select("__a", "__b", *groups, "start_pos", "end_pos", "__fresh", "__asks").mapInArrow(meet, ", ".join(kinds)).select(F.col("__a").alias(key), F.col("__b").alias(other))


def overlap_flag(a: DataFrame, b: DataFrame, name: str, key: str, size: int = BIN) -> DataFrame:
    """``a`` with a boolean ``name``: whether any interval of ``b`` overlaps."""
    hit = overlap_totals(a, b, key, {}).withColumn(name, F.lit(True))
    return a.join(apart(hit), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def overlap_semi(a: DataFrame, b: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """Rows of ``a`` whose key has an overlap in ``b``; rows with a null key or place go. Keys should name rows."""
    return a.join(apart(overlap_totals(a, b, key, {})), key, "left_semi")


def overlap_anti(a: DataFrame, b: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """Rows of ``a`` whose key has no overlap in ``b``; rows with a null key or place stay."""
    return a.join(apart(overlap_totals(a, b, key, {})), key, "left_anti")


def background_loci(sizes: DataFrame, peaks: DataFrame, n: int, width: int, seed: int = 0) -> DataFrame:
    """``n`` hash-drawn windows that touch no peak: (candidate, chrom, start_pos, end_pos). A bounded sample by intent."""
    draw = lambda what: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(what), "chrom", "candidate"), 256), 1, 12), 16, 10).cast("long")
    rows = sizes.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(4 * n))))
    rows = rows.withColumn("start_pos", F.pmod(draw("place"), F.greatest(F.col("size") - width, F.lit(1)))).withColumn("end_pos", F.col("start_pos") + width)
    rows = rows.withColumn("place", F.concat_ws(":", "chrom", "candidate"))
    return overlap_anti(rows, peaks, "place").withColumn("order", draw("order")).orderBy("order", "place").limit(n).select("place", "chrom", "start_pos", "end_pos")


def _nodes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``level`` and ``node``, a row for each of the fewest aligned stretches of 2^level bases that make the interval up."""
    levels = rows.withColumn("level", F.explode(F.expr("sequence(0, cast(ceil(log2(end_pos - start_pos + 1)) as int))")))
    levels = levels.withColumn("__lo", F.expr("shiftright(start_pos + shiftleft(1L, level) - 1, level)")).withColumn("__hi", F.expr("shiftright(end_pos, level)")).where("__lo < __hi")
    ends = F.array(F.expr("if(__lo & 1 = 1, __lo, null)"), F.expr("if(__hi & 1 = 1, __hi - 1, null)"))
    return levels.withColumn("node", F.explode(ends)).where("node is not null").drop("__lo", "__hi", "start_pos", "end_pos")


def _above(points: DataFrame, levels: int) -> DataFrame:
    """``points`` with ``level`` and ``node`` of all aligned stretches of up to 2^levels bases that hold ``at``."""
    rows = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return rows.withColumn("node", F.expr("shiftright(at, level)")).drop("at")


#: Bases a bin of ``overlap_tops``, a power of two: a task holds a few numbers for each, times its logarithm.
REACH = 1 << 13
_NONE, _BITS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, NaN last; ``_ordered`` of these as doubles leads back."""
    bits = np.where(np.isnan(values), np.nan, values).view(np.int64)
    return bits ^ (bits >> 63 & _BITS)


def overlap_tops(a: DataFrame, b: DataFrame, key: str, values: Mapping[str, Column], size: int = BIN) -> DataFrame:
    """(key, values): the largest of each of ``values``, columns of ``b`` taken as doubles, over all overlaps of the key's
    rows; null without any. Keys are those of ``a`` with a place, null keys not.

    No pair is made: intervals overlap where one holds the other's start. A row goes to the bins that its ends lie in; there
    maxima of starts and of covered bases lie in aligned stretches of 1, 2, 4, .. bases on arrays, so a task holds a bin's
    arrays, however many rows it has, and a row costs two look-ups. What lies between the ends' bins is looked up in aligned
    stretches of bins. Equal places are one row. Rows of no length meet in bins; null places overlap nothing.
    """
    names, place = list(values), ["chrom", "start_pos", "end_pos"]
    whole, flat = "chrom is not null and start_pos < end_pos", "chrom is not null and start_pos >= end_pos"
    bits = REACH.bit_length() - 1
    ends = {c: F.col(c).cast("long") for c in ("start_pos", "end_pos")}
    mine = a.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), "chrom", *[v.alias(c) for c, v in ends.items()])
    theirs = b.select("chrom", *[v.alias(c) for c, v in ends.items()], *[v.cast("double").alias(k) for k, v in values.items()])
    most = [F.max(k).alias(k) for k in names]
    first, last = F.expr(f"shiftright(start_pos, {bits})"), F.expr(f"shiftright(end_pos - 1, {bits})")
    asks = mine.where(whole).select(*place).distinct()
    long = theirs.where(whole).groupBy(*place).agg(*most)
    in_bins = lambda df: df.withColumn("bin", F.explode(F.array_distinct(F.array(first, last))))
    met = in_bins(long.withColumn("__asks", F.lit(False))).unionByName(in_bins(asks.withColumn("__asks", F.lit(True))), allowMissingColumns=True)
    met = met.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "__asks")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, closed = None, False
        starts, cover = (np.full((len(names), bits + 1, REACH), _NONE) for _ in range(2))
        for batch in batches:
            if not batch.num_rows:
                continue
            differs = np.zeros(batch.num_rows - 1, bool)
            for g in ("chrom", "bin"):
                differs |= pc.not_equal(batch[g][1:], batch[g][:-1]).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(differs) + 1, batch.num_rows]
            turn = batch["__asks"].to_numpy(zero_copy_only=False)
            at = batch["bin"].to_numpy() * REACH
            lo, hi = batch["start_pos"].to_numpy() - at, np.minimum(batch["end_pos"].to_numpy() - at, REACH)
            tall = np.frexp(hi - np.maximum(lo, 0))[1] - 1  # the level of the longest stretch that fits
            held = [(batch[k].is_valid().to_numpy(zero_copy_only=False), _ordered(batch[k].fill_null(0.0).to_numpy(zero_copy_only=False))) for k in names]
            found = np.full((len(names), batch.num_rows), _NONE)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                here = (batch["chrom"][i].as_py(), batch["bin"][i].as_py())
                if here != now:
                    now, closed = here, False
                    starts.fill(_NONE)
                    cover.fill(_NONE)
                m = i + int(np.searchsorted(turn[i:j], True))  # rows of b come first
                for v, (valid, value) in enumerate(held if m > i else ()):
                    n = np.flatnonzero(valid[i:m]) + i
                    np.maximum.at(cover[v], (tall[n], np.maximum(lo[n], 0)), value[n])
                    np.maximum.at(cover[v], (tall[n], hi[n] - (1 << tall[n])), value[n])
                    n = n[lo[n] >= 0]
                    np.maximum.at(starts[v, 0], lo[n], value[n])
                if m == j:
                    continue
                if not closed:
                    closed = True
                    for k in range(bits):
                        h = 1 << k
                        np.maximum(starts[:, k, :-h], starts[:, k, h:], out=starts[:, k + 1, :-h])
                    for k in range(bits, 0, -1):
                        h = 1 << k - 1
                        np.maximum(cover[:, k - 1], cover[:, k], out=cover[:, k - 1])
                        np.maximum(cover[:, k - 1, h:], cover[:, k, :-h], out=cover[:, k - 1, h:])
                n = np.arange(m, j)
                x, k = np.maximum(lo[n], 0), tall[n]
                over = np.maximum(starts[:, k, x], starts[:, k, hi[n] - (1 << k)])
                found[:, n] = np.where(lo[n] >= 0, np.maximum(over, cover[:, 0, x]), over)
            n = np.flatnonzero(turn)
            back = (found[:, n] ^ (found[:, n] >> 63 & _BITS)).view(np.float64)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(n)) for c in place] + [pa.array(x, mask=y == _NONE) for x, y in zip(back, found[:, n])], [*place, *names])

    kind = a.schema["chrom"].dataType.simpleString()
    met = met.select(*place, "bin", "__asks", *names).mapInArrow(tops, ", ".join([f"chrom {kind}, start_pos long, end_pos long", *[f"`{k}` double" for k in names]]))
    far = lambda df: df.agg(F.max(F.when(F.expr(whole), last - first - 1)), F.coalesce(F.max(F.expr(flat)), F.lit(False))).first()
    (far_a, odd_a), (far_b, odd_b) = far(mine), far(theirs)
    between = lambda df: _nodes(df.select("*", (first + 1).alias("__lo"), last.alias("__hi")).where("__lo < __hi").drop("start_pos", "end_pos").withColumnsRenamed({"__lo": "start_pos", "__hi": "end_pos"}))
    named = asks.select("*", F.struct(*place).alias("__of"))
    up = lambda n: int(n).bit_length()
    for some, asked, n in ((lambda: _above(long.select("chrom", first.alias("at"), *names), up(far_a)), lambda: between(named), far_a), (lambda: between(long), lambda: _above(named.select("chrom", "__of", first.alias("at")), up(far_b)), far_b)):
        if n and n > 0:
            stretch = ["chrom", "level", "node"]
            met = met.unionByName(asked().join(apart(some().groupBy(*stretch).agg(*most)), stretch).select("__of.*", *names))
    out = mine.join(apart(met.groupBy(*place).agg(*most)), place).select("__key", *names)
    if odd_a or odd_b:
        pairs = overlap_join(mine.where(flat), theirs, size=size).unionByName(overlap_join(mine.where(whole), theirs.where(flat), size=size))
        out = out.unionByName(pairs.select("__key", *[F.col(f"b_{k}").alias(k) for k in names]))
    return out.groupBy(F.col("__key").alias(key)).agg(*most)


def overlap_max(a: DataFrame, b: DataFrame, value: str, key: str, size: int = BIN, flag: str | None = None) -> DataFrame:
    """``a`` with ``best``: the largest value over overlaps, 0 without any; with ``flag``, whether there is one too.

    From ``overlap_tops``, so no pair is made; null keys and places overlap nothing.
    """
    tops = overlap_tops(a, b, key, {"__best": F.col(value)} | ({"__flag": F.lit(1.0)} if flag else {}), size)
    out = a.join(apart(tops), key, "left").withColumn("best", F.coalesce("__best", F.lit(0.0)))
    return out.withColumn(flag, F.col("__flag").isNotNull()).drop("__best", "__flag") if flag else out.drop("__best")


def merge_intervals(df: DataFrame) -> DataFrame:
    """Islands of intervals that overlap or touch: (chrom, start_pos, end_pos, n).

    Intervals are cut into range slices of (chrom, start); a slice takes over the reach of the slices before it and the
    start of the island that this leaves open, a number each, so no chromosome or island meets in one task. Null
    chromosomes are one chromosome; rows with a null start or end are passed over; repeated rows each count.
    """
    order = ["start_pos", "end_pos"]
    cut = sliced(df.where("start_pos is not null and end_pos is not null").select("chrom", *order), ["chrom", *order], alone=True)
    cut = carried(cut, ["chrom"], order, {"__reach": ("max", F.col("end_pos"))}, before=True)
    fresh = F.when(F.col("__reach").isNull() | (F.col("start_pos") > F.col("__reach")), F.col("start_pos"))
    cut = carried(cut, ["chrom"], order, {"__island": ("max", fresh)})
    return cut.groupBy("chrom", "__island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n")).drop("__island")


def points_in_regions(points: DataFrame, regions: DataFrame, pos: str = "pos", size: int = BIN) -> DataFrame:
    """Points inside merged regions, both ends closed.

    Points or regions with a null chromosome or place meet nothing; a repeated point stays as often as it comes.
    """
    merged = merge_intervals(regions)
    right = _binned(_prefixed(merged), "b_start_pos", "b_end_pos", size, "__b")
    right = right.unionByName(right.where((F.col("b_end_pos") % size == 0)).withColumn("bin", F.expr(f"b_end_pos div {size}"))).distinct()
    meet = (F.col("chrom") == F.col("b_chrom")) & (F.expr(f"`{pos}` div {size}") == F.col("bin")) & F.col(pos).between(F.col("b_start_pos"), F.col("b_end_pos"))
    return points.join(right, meet, "left_semi")


def nearest_distance(a: DataFrame, points: DataFrame, pos: str = "pos", stretch: int = 1 << 22) -> DataFrame:
    """``a`` with ``distance`` to the nearest point of its chromosome (null if there is none), by windows both ways.

    Windows run per stretch of a chromosome; each stretch also sees the last point before and the first after it.
    """
    marks = points.select("chrom", F.col(pos).alias("__p"), F.expr(f"`{pos}` div {stretch}").alias("__s")).distinct()
    ends = marks.groupBy("chrom", "__s").agg(F.min("__p").alias("lo"), F.max("__p").alias("hi"))
    # The distance depends on the place alone, so places are compared, not rows.
    rows = a.where(F.col("chrom").isNotNull() & F.col(pos).isNotNull()).select("chrom", F.col(pos).alias("__p"), F.expr(f"`{pos}` div {stretch}").alias("__s")).distinct()
    both = rows.withColumn("__asks", F.lit(True)).unionByName(marks.withColumn("__asks", F.lit(False)))
    mark = F.when(~F.col("__asks"), F.col("__p"))
    back = Window.partitionBy("chrom", "__s").orderBy("__p").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("chrom", "__s").orderBy(F.desc("__p")).rangeBetween(Window.unboundedPreceding, 0)  # a frame that grows is linear
    near = both.select("*", F.max(mark).over(back).alias("before"), F.min(mark).over(ahead).alias("after")).where("__asks")
    needed = near.select("chrom", "__s").distinct()
    over = Window.partitionBy("chrom").orderBy("__s")
    steps = needed.withColumn("want", F.lit(1)).join(ends, ["chrom", "__s"], "full")
    steps = steps.select("chrom", "__s", F.max("hi").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("last"), F.min("lo").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    found = near.join(steps, ["chrom", "__s"], "left")
    gap = F.least(F.col("__p") - F.greatest("before", "last"), F.least("after", "next") - F.col("__p"))
    found = found.select(F.col("chrom").alias("__chrom"), F.col("__p").alias("__place"), gap.alias("distance"))
    return a.join(found, (F.col("chrom") == F.col("__chrom")) & (F.col(pos) == F.col("__place")), "left").drop("__chrom", "__place")


#: Bases a stretch: at most three rows a base meet in a task, as what lies at one place is summed first.
STRETCH = 1 << 16


def _totals_at(points: DataFrame, b: DataFrame, totals: Mapping[str, Column], keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """(keys, at, <total>_s, <total>_e) of distinct points (keys, at): sums over the rows of ``b`` that start before the
    point, and over those that end at it or before; written.

    Starts and ends of one place are summed first; these and the points are put in order and summed within stretches of
    bases, which take over the sums of the stretches before them, so nothing is ordered as a whole or written twice.
    """
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    rows = b.where(known & F.expr("start_pos <= end_pos")).select(*keys, "start_pos", "end_pos", *[v.alias(k) for k, v in totals.items()])
    # At one place ends come first, then points, then starts.
    sides = F.explode(F.array(F.struct(F.col("end_pos").alias("at"), F.lit(0).alias("rank")), F.struct(F.col("start_pos").alias("at"), F.lit(2).alias("rank"))))
    events = rows.select(*keys, sides.alias("e"), *totals).select(*keys, "e.at", "e.rank", *totals)
    sums = {f"{k}_{side}": F.when(F.col("rank") == rank, F.col(k)) for k in totals for side, rank in (("s", 2), ("e", 0))}
    marks = points.withColumn("rank", F.lit(1))
    cut = lambda some: marks.unionByName(some, allowMissingColumns=True).withColumn("__in", F.expr(f"at div {STRETCH}"))
    here = Window.partitionBy(*keys, "__in").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = cut(events.groupBy(*keys, "at", "rank").agg(*[F.sum(k).alias(k) for k in totals])).withColumns({k: F.sum(v).over(here) for k, v in sums.items()}).where("rank = 1")
    ahead = Window.partitionBy(*keys).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    whole = cut(events).groupBy(*keys, "__in").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    earlier = whole.select(*keys, "__in", *[F.sum(k).over(ahead).alias(f"__c_{k}") for k in sums])
    both = [F.coalesce(F.col(k) + F.col(f"__c_{k}"), k, f"__c_{k}", F.lit(0)).alias(k) for k in sums]
    return written(seen.join(earlier, [*keys, "__in"]).select(*keys, "at", *both), "totals")


def looked_up(loci: DataFrame, b: DataFrame, totals: Mapping[str, Column], keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``loci`` with ``_totals_at`` their starts (lo_<total>_s, ..) and ends (hi_..); rows without a place have none."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    points = loci.where(known).select(*keys, F.explode(F.array("start_pos", "end_pos")).alias("at")).where("at is not null").distinct()
    found = _totals_at(points, b, totals, keys)
    for end, column in (("lo", "start_pos"), ("hi", "end_pos")):
        side = found.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("at").alias("__at"), *[F.col(c).alias(f"{end}_{c}") for k in totals for c in (f"{k}_s", f"{k}_e")])
        same = reduce(Column.__and__, [F.col(k) == F.col(f"__k_{k}") for k in keys], F.col(column) == F.col("__at"))
        loci = loci.join(apart(side), same, "left").drop("__at", *[f"__k_{k}" for k in keys])
    return loci


def overlap_totals(a: DataFrame, b: DataFrame, key: str, totals: Mapping[str, Column]) -> DataFrame:
    """(key, totals): sums of columns of ``b`` over all overlaps of the key's rows; keys without an overlap have no row.

    No pair is made: what overlaps is what starts before the end less what ends up to the start, so work follows the rows
    of both tables, however many overlap. Rows of ``a`` of no length meet in bins; null keys and rows of ``b`` that end
    before they start are passed over.
    """
    named = {f"__t_{k}": v for k, v in totals.items()} | {"__t_rows": F.lit(1).cast("long")}
    mine = a.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), "chrom", "start_pos", "end_pos")
    long = looked_up(mine.where("start_pos < end_pos"), b, named)
    found = long.select("__key", *[(F.col(f"hi_{k}_s") - F.col(f"lo_{k}_e")).alias(k) for k in named]).where("__t_rows > 0")
    flat = mine.where("start_pos >= end_pos")
    if not flat.isEmpty():
        met = overlap_join(flat, b.where("start_pos <= end_pos").select("chrom", "start_pos", "end_pos", *[v.alias(k) for k, v in named.items()]))
        found = found.unionByName(met.select("__key", *[F.col(f"b_{k}").alias(k) for k in named]))
    if not totals:
        return found.select(F.col("__key").alias(key)).distinct()
    return found.groupBy(F.col("__key").alias(key)).agg(*[F.sum(f"__t_{k}").alias(k) for k in totals])


def window_means(loci: DataFrame, track: DataFrame, key: str, of: Mapping[str, Column], value: str = "value") -> DataFrame:
    """``loci`` with a column for each of ``of``: plain mean, not weighted, of the records that overlap and that it holds
    for; null records are skipped.

    From running totals, so no pair is made. Values are summed as decimals of some 27 digits, as a total over a chromosome
    would take digits from doubles.
    """
    records = track.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__v", F.col(value).cast("double"))
    most = records.agg(F.max(F.abs("__v"))).first()[0] or 1.0
    scale = min(18, 27 - len(str(int(most)))) if most < 1e26 else None
    summed = F.col("__v").cast(f"decimal(28,{scale})") if scale is not None else F.col("__v")
    totals = {f"__sum_{k}": F.when(of[k], summed) for k in of} | {f"__rows_{k}": F.when(of[k], F.lit(1).cast("long")) for k in of}
    found = overlap_totals(loci, records, key, totals)
    return loci.join(apart(found.select(key, *[F.try_divide(F.col(f"__sum_{k}").cast("double"), F.col(f"__rows_{k}")).alias(k) for k in of])), key, "left")


def window_mean(loci: DataFrame, track: DataFrame, key: str, value: str = "value", size: int = BIN) -> DataFrame:
    """``loci`` with ``mean``: plain mean of the records that overlap, not weighted; null records are skipped."""
    return window_means(loci, track, key, {"mean": F.lit(True)}, value)


def extend_reads(reads: DataFrame, fragment: int) -> DataFrame:
    """Reads drawn out to ``fragment`` bases from their 5' end."""
    plus = F.col("strand") != "-"
    return reads.withColumn("__s", F.when(plus, F.col("start_pos")).otherwise(F.greatest(F.lit(0), F.col("end_pos") - fragment))).withColumn(
        "end_pos", F.when(plus, F.col("start_pos") + fragment).otherwise(F.col("end_pos"))).withColumn("start_pos", F.col("__s")).drop("__s")


def _runs(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start_pos, end_pos, depth) of events (keys, end_pos, __by), one a place: runs of one depth other than 0."""
    cut = sliced(events, [*keys, "end_pos"], alone=True)
    runs = carried(cut, keys, ["end_pos"], {"depth": ("sum", F.col("__by")), "start_pos": ("max", F.col("end_pos"))}, before=True).where("depth > 0")
    return runs.select(*keys, "start_pos", "end_pos", "depth")


def _events(rows: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """Events of rows (keys, start_pos, end_pos), ``by`` at the start and less it at the end; places where the depth stays
    have none, so the runs on both sides are one."""
    ends = F.array(F.struct(F.col("start_pos").alias("at"), by.alias("by")), F.struct(F.col("end_pos").alias("at"), (-by).alias("by")))
    return rows.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.at").alias("end_pos")).agg(F.sum("e.by").alias("__by")).where("__by <> 0")


def coverage_runs(reads: DataFrame, regions: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """(key, start_pos, end_pos, depth): the pile-up of reads in each region as runs of one depth, 1 or more.

    A read gives two events, +1 at its start and -1 at its end; events of one place are summed, and a run lies between two
    places with the sum of all events up to the first. Runs are made once a chromosome and cut to the regions, so no read
    meets a region and work follows reads and runs. Regions that share a key are one pile-up, summed from their runs; rows
    with a null key, chromosome or end give nothing; repeated reads each count.
    """
    whole = reads.where("chrom is not null and start_pos < end_pos").select("chrom", "start_pos", "end_pos")
    runs = written(_runs(_events(whole, ["chrom"], F.lit(1)), ["chrom"]), "runs")
    mine = regions.where(F.col(key).isNotNull() & (F.col("start_pos") < F.col("end_pos"))).select(key, "chrom", "start_pos", "end_pos")
    width = choose_bin(mine) if size == BIN else size
    inside = lambda some: overlap_join(some, runs, size=width).select(
        key, F.greatest("start_pos", "b_start_pos").alias("start_pos"), F.least("end_pos", "b_end_pos").alias("end_pos"), F.col("b_depth").alias("depth"))
    shared = mine.groupBy(key).count().where("count > 1").select(key)
    if shared.isEmpty():
        return inside(mine)
    many = _runs(_events(inside(mine.join(shared, key, "left_semi")), [key], F.col("depth")), [key])
    return inside(mine.join(shared, key, "left_anti")).unionByName(many)


def coverage(reads: DataFrame, regions: DataFrame, key: str, per_base: bool = False, size: int = BIN) -> DataFrame:
    """Read pile-up in regions: (key, pos, depth) per base that a read covers, or ``regions`` with the mean depth.

    Bases come from ``coverage_runs``, so a base is made once, not once a read; mean depths from running totals. Repeated reads each count; a region without
    reads has mean depth 0 and no bases; an empty region has a null mean.
    """
    if per_base:
        return coverage_runs(reads, regions, key, size).select(key, F.explode(F.expr("sequence(start_pos, end_pos - 1)")).alias("pos"), "depth")
    # Bases up to a place: of every read that starts before it, the place less its start; less the same from its end on.
    ends = {"n": F.lit(1).cast("long"), "start": F.col("start_pos").cast("long"), "end": F.col("end_pos").cast("long")}
    mine = regions.where(F.col(key).isNotNull() & (F.col("start_pos") < F.col("end_pos"))).select(key, "chrom", "start_pos", "end_pos")
    upto = lambda end, at: F.col(at) * (F.col(f"{end}_n_s") - F.col(f"{end}_n_e")) - (F.col(f"{end}_start_s") - F.col(f"{end}_end_e"))
    depth = looked_up(mine, reads, ends).groupBy(key).agg(F.sum(upto("hi", "end_pos") - upto("lo", "start_pos")).alias("bases"))
    return regions.join(apart(depth), key, "left").withColumn("depth", F.try_divide(F.coalesce("bases", F.lit(0)), F.col("end_pos") - F.col("start_pos"))).drop("bases")


def tss_window(df: DataFrame, up: int, down: int) -> DataFrame:
    """``df`` with ``up`` bases before and ``down`` after the start site, by strand, from 0 on; no strand reads as minus."""
    plus = F.col("strand") == "+"
    return df.withColumn("start_pos", F.greatest(F.lit(0), F.when(plus, F.col("tss") - up).otherwise(F.col("tss") - down))).withColumn(
        "end_pos", F.when(plus, F.col("tss") + down).otherwise(F.col("tss") + up))


def mark_calls(loci: DataFrame, case: DataFrame, control: DataFrame, marks: Iterable[str], key: str, size: int = BIN) -> DataFrame:
    """(key, <mark>_case, <mark>_control, <mark>_gain) from interval tables with a ``mark`` column; from ``overlap_tops``, all
    calls at once, so no pair is made. A null key has no calls."""
    both = case.select("chrom", "start_pos", "end_pos", "mark", F.lit("case").alias("side")).unionByName(control.select("chrom", "start_pos", "end_pos", "mark", F.lit("control").alias("side")))
    marks = list(marks)
    asked = {f"{m}_{s}": F.when((F.col("mark") == m) & (F.col("side") == s), 1.0) for m in marks for s in ("case", "control")}
    tops = overlap_tops(loci, both.where(F.col("mark").isin(marks)), key, {f"__t_{k}": v for k, v in asked.items()}, size)
    calls = loci.select(key).distinct().join(apart(tops), key, "left").select(key, *[F.col(f"__t_{k}").isNotNull().alias(k) for k in asked])
    return calls.select("*", *[(F.col(f"{m}_case") & ~F.col(f"{m}_control")).alias(f"{m}_gain") for m in marks])


def spaced_topk(df: DataFrame, key: str, distance: int, k: int) -> DataFrame:
    """Per ``key`` the strongest intervals at least ``distance`` apart (by start), at most ``k``; a bounded pick by intent.

    Rows are picked in one order: by falling signal, then by coordinates. Of rows that share a start only the first can be
    picked. A pick rules out rows of three cells of ``distance`` bases at most, so while fewer than k are picked one of the
    key's 3k first cells is open, and no pick comes after the first row of the last of these. Only rows up to there meet in
    a key's Arrow group: they lie in 3k cells, so they are 3k x ``distance`` at most, whatever the ties. Rows with a null
    chromosome, start or signal are passed over; null keys are a key; repeated rows count once.
    """
    order = F.struct((-F.col("signal")).alias("signal"), F.col("chrom").alias("chrom"), F.col("start_pos").alias("start_pos"), F.col("end_pos").alias("end_pos"))
    rows = df.where("chrom is not null and start_pos is not null and signal is not null")
    best = rows.groupBy(*dict.fromkeys([key, "chrom", "start_pos"])).agg(F.min(order).alias("__order"))
    cells = best.groupBy(*dict.fromkeys([key, "chrom"]), F.expr(f"start_pos div {distance}").alias("__cell")).agg(F.min("__order").alias("__top"))
    first = cells.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__top"))).where(F.col("__r") <= 3 * k)
    last = first.groupBy(F.col(key).alias("__key")).agg(F.max("__top").alias("__last"))
    few = best.join(last, F.col(key).eqNullSafe(F.col("__key"))).where(F.col("__order") <= F.col("__last"))
    few = few.select(*dict.fromkeys([key, "chrom", "start_pos"]), F.col("__order.end_pos").alias("end_pos"), (-F.col("__order.signal")).alias("signal"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["signal", "chrom", "start_pos", "end_pos"], ascending=[False, True, True, True])
        kept: list[int] = []
        seen: dict[str, list[int]] = {}
        for n, (chrom, start) in enumerate(zip(rows["chrom"], rows["start_pos"])):
            if all(abs(start - o) >= distance for o in seen.get(chrom, ())):
                kept.append(n)
                seen.setdefault(chrom, []).append(start)
                if len(kept) == k:
                    break
        return rows.iloc[kept]

    return few.groupBy(key).applyInPandas(pick, few.schema)


def duplication_audit(df: DataFrame, by: str = "chrom") -> DataFrame:
    """Intervals, distinct coordinates, redundant share and duplication factor, per ``by`` and in total (null)."""
    cells = df.groupBy(by, "chrom", "start_pos", "end_pos").count() if by != "chrom" else df.groupBy("chrom", "start_pos", "end_pos").count()
    out = cells.rollup(by).agg(F.sum("count").alias("n"), F.count("*").alias("n_distinct"))
    return out.withColumn("redundant", 1 - F.col("n_distinct") / F.col("n")).withColumn("factor", F.col("n") / F.col("n_distinct"))
