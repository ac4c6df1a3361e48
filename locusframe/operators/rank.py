"""Multi-objective ranking and evidence scores. Objectives are columns in [0, 1], larger is better."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.iterate import written
from locusframe.operators.scan import running, sliced
from locusframe.operators.stats import hash_bits

OBJECTIVES = ("efficacy", "specificity", "robustness", "safety")

#: Fixed values of the evidence scores: weights, the values at which a part counts fully, and where silencing begins.
CONVERGENCE = {"percentile": 0.28, "log2fc": 0.20, "master": 0.16, "targets": 0.12, "amp": 0.12, "driver": 0.06, "subtype": 0.06, "silencing": 0.15}
DIRECTION = {"log2fc": 0.30, "copies": 0.20, "beta": 0.20, "det": 0.15, "residual": 0.15}
ROLE = {"copies": 0.7, "beta": 0.3}
FULL_LOG2FC, FULL_COPIES, FULL_RESIDUAL, DET_FROM, BETA_FROM = 4, 0.3, 2, 0.3, 0.5


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """A column within [lo, hi]; null becomes ``lo``."""
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def efficacy(*parts: str) -> Column:
    """Geometric mean; 0 if a part is 0 or less."""
    cs = [clip(F.col(p)) for p in parts]
    return F.when(F.least(*cs) <= 0, 0.0).otherwise(F.exp(reduce(Column.__add__, [F.log(c) for c in cs]) / len(cs)))


def specificity(likelihood: str, overlap: str, leak: str, w: tuple[float, float] = (0.5, 0.5)) -> Column:
    """Weighted likelihood and overlap less leakage, within [0, 1]; a null input counts as 0."""
    return clip(w[0] * clip(F.col(likelihood)) + w[1] * clip(F.col(overlap)) - F.greatest(F.col(leak), F.lit(0.0)))


def safety(*risks: str) -> Column:
    """Product of one minus each risk; a null risk counts as 0."""
    return clip(reduce(Column.__mul__, [1 - clip(F.col(r)) for r in risks]))


def composite(objectives: Sequence[str] = OBJECTIVES, weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of the objectives; null if one is."""
    w = list(weights or [1.0] * len(objectives))
    return reduce(Column.__add__, [F.col(o) * (x / sum(w)) for o, x in zip(objectives, w)])


#: Points that meet in one task: a block in falling order of sums, and the rows that are held against it at once.
BLOCK, AGAINST = 20_000, 50_000


def _falling(names: Sequence[str]) -> list[Column]:
    """An order in which who dominates comes first: by falling sum, which rounding keeps in order, then by falling values."""
    return [F.desc("__sum"), *[F.desc(o) for o in names]]


def _points(df: DataFrame, names: Sequence[str], part: Sequence[str]) -> DataFrame:
    """The distinct points of each part, written."""
    return written(df.select(*part, *[F.col(o).cast("double").alias(o) for o in names]).distinct(), "points")


def _placed(points: DataFrame, names: Sequence[str], part: Sequence[str], block: int) -> DataFrame:
    """``points`` with ``__b``, their block in falling order within their part; written."""
    points = points.withColumn("__sum", reduce(Column.__add__, [F.col(o) for o in names]))
    placed = running(points, part, _falling(names), {"__at": F.lit(1).cast("long")}, alone=True)
    return written(placed.select(*part, *names, F.expr(f"int((__at - 1) div {block})").alias("__b")), "blocks")


#: Chains up to which points are ranked along chains, points that a chain holds at least on average, points a slice of these.
CHAINS, LINKS, SLICE = 2_000, 8, 250_000


def _lead(points: DataFrame, names: Sequence[str], part: Sequence[str]) -> str | None:
    """The objective along which points make chains: those that agree in all others are in order by it. None if the chains
    of a part are many."""
    n, *kinds = points.agg(F.count("*"), *[F.approx_count_distinct(o) for o in names]).first()
    lead = names[int(np.argmax(kinds))]
    rest = [o for o in names if o != lead]
    chains = points.select(*part, *rest).distinct()
    total, most = chains.groupBy(*part).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    return lead if n and most <= CHAINS and total * LINKS <= n else None


def _along(codes: np.ndarray, chain: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Front of each of ``chain``, the chains of points in falling order of the lead and then of the others. ``codes`` are the
    chains' other objectives, ``last`` their last fronts so far (-1 without one), which is brought up to date."""
    above = reduce(np.logical_and, [c[None, :] >= c[:, None] for c in codes.T], np.ones((len(codes), len(codes)), bool))
    above = [np.flatnonzero(a) for a in above]
    out = np.empty(len(chain), np.int64)
    for k, c in enumerate(chain.tolist()):
        out[k] = last[c] = last[above[c]].max() + 1
    return out


def _chained(points: DataFrame, names: Sequence[str], part: Sequence[str], lead: str, known: int | None, size: int) -> DataFrame:
    """(part, objectives, rank) of points that make few chains: a front is one more than the last front so far of the chains
    that are as high in all but ``lead``, so a point costs a look at the chains and not at the points before it.

    Slices of about ``size`` points in falling order of ``lead`` come one after the other, and only each chain's last front
    goes on to the next one.
    """
    rest = [o for o in names if o != lead]
    order = [F.desc(lead), *[F.desc(o) for o in rest]]
    cut = sliced(points, [*order, *part], size, alone=True)
    ends = cut.agg(F.max("__slice")).first()[0]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*part, *names).schema)
    keys = list(part) or ["__one"]

    def rank(rows: pa.Table, before: pa.Table) -> pa.Table:
        mine = np.column_stack([rows[o].to_numpy() for o in [lead, *rest]])
        rows = rows.take(pa.array(np.lexsort((-mine).T[::-1])))
        mine, theirs = ([t[o].combine_chunks().to_numpy() for o in rest] for t in (rows, before))
        both = np.column_stack([np.r_[a, b] for a, b in zip(theirs, mine)]) if rest else np.zeros((before.num_rows + rows.num_rows, 0))
        codes, of = np.unique(both, axis=0, return_inverse=True) if rest else (both[:1], np.zeros(len(both), np.int64))
        last = np.full(len(codes), -1, np.int64)
        last[of.ravel()[: before.num_rows]] = before["rank"].to_numpy()
        ranks = _along(codes, of.ravel()[before.num_rows :], last)
        return rows.select([*part, *names]).append_column("rank", pa.array(ranks, pa.int32()))

    one = F.lit(0).alias("__one")
    found, state = [], points.where(F.lit(False)).select(*part, *rest, F.lit(0).alias("rank"))
    for k in range((ends if ends is not None else -1) + 1):
        mine = cut.where(F.col("__slice") == k).select(*part, *names, one)
        here = mine.groupBy(*keys).cogroup(state.select("*", one).groupBy(*keys)).applyInArrow(rank, f"{fields}, rank int")
        found.append(written(here, "fronts"))
        if k < ends:
            state = written(state.unionByName(found[-1].select(*state.columns)).groupBy(*part, *rest).agg(F.max("rank").alias("rank")), "chains")
    out = reduce(DataFrame.unionByName, found) if found else points.select(*part, *names, F.lit(0).alias("rank"))
    return out if known is None else out.where(F.col("rank") < known)


def _complete(names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double")) for o in names])


#: Rows whose lists one task makes; the most tasks, so that what is shuffled grows as the table does; entries of lists
#: that leave a task at once.
LISTS, MOST_TASKS, ENTRIES = 500, 192, 4_000_000


def _packed(df: DataFrame, name: str, of: str | None = None) -> DataFrame:
    """``df`` as blocks of rows, a compressed binary each, with their number; with ``of``, a boolean, only rows that it holds for."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch if of is None else batch.filter(batch[of])
            into = pa.BufferOutputStream()
            with pa.ipc.new_stream(into, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([into.getvalue().to_pybytes()])], [name])

    return df.mapInArrow(pack, f"{name} binary").withColumn(f"{name}_n", F.monotonically_increasing_id())


def dominance(df: DataFrame, key: str, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """(key, dominated_by): who is at least as good in all objectives and better in one, by key.

    What comes out grows with the square of the rows, but no pair is shuffled, and points are not either: these are written
    once, as blocks, which each of at most MOST_TASKS tasks reads; rows are dealt to the tasks by key, and a row's list leaves
    as soon as it is made. A task holds a key and a few bytes for each point, as the longest list may. A null or NaN
    objective dominates nothing and is dominated by nothing; rows that share a key are one in ``dominated_by`` and share a list.
    """
    values = [f"__v{j}" for j in range(len(objectives))]
    whole = F.coalesce(_complete(objectives), F.lit(False)) & F.col(key).isNotNull()
    rows = df.select(F.col(key).alias("__k"), *[F.col(o).cast("double").alias(v) for o, v in zip(objectives, values)], whole.alias("__whole"))
    tasks = min(MOST_TASKS, max(1, -(-df.count() // LISTS)))
    points = written(_packed(rows, "__points", "__whole"), "points")
    asks = _packed(rows.withColumn("__task", F.pmod(F.xxhash64("__k"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("__task")).sortWithinPartitions("__k"), "__asks")
    met = asks.crossJoin(points.coalesce(1).hint("shuffle_replicate_nl"))  # each block of rows meets all points, read anew in each task

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[pa.Table]]]:
        """Blocks of rows with the points, which come with the first of them."""
        held, turn, first, asked = [], 0, None, None
        for batch in batches:
            for rows, points, n in zip(batch["__asks"], batch["__points"], batch["__points_n"].to_pylist()):
                first = n if first is None else first
                if n == first:
                    if turn:
                        yield pa.ipc.open_stream(asked).read_all(), held
                        held = []
                    asked, turn = rows.as_py(), turn + 1
                if turn == 1:
                    held.append(pa.ipc.open_stream(points.as_py()).read_all())
        if turn:
            yield pa.ipc.open_stream(asked).read_all(), held

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None
        for mine, held in blocks(batches):
            if keys is None:
                table = pa.concat_tables(held).sort_by("__k")
                keys = table["__k"].combine_chunks()
                fresh = np.r_[True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)] if len(keys) else np.zeros(0, bool)
                keys, named = keys.filter(pa.array(fresh)), None if fresh.all() else np.cumsum(fresh) - 1
                steps = [np.unique(table[v].to_numpy()) for v in values]
                codes = [np.searchsorted(s, table[v].to_numpy()).astype(np.min_scalar_type(len(s))) for v, s in zip(values, steps)]
                del table
                now, ready, total = None, [], 0
            low = [np.searchsorted(s, mine[v].to_numpy()).astype(c.dtype) for v, s, c in zip(values, steps, codes)]
            for n, (k, asked) in enumerate(zip(mine["__k"].to_pylist(), mine["__whole"].to_pylist())):
                found = np.zeros(0, np.int64)
                if asked:
                    above = reduce(np.logical_and, [c >= x[n] for c, x in zip(codes, low)])
                    found = np.flatnonzero(above)
                    found = found[reduce(np.logical_or, [c[found] > x[n] for c, x in zip(codes, low)])]
                    found = found if named is None else np.unique(named[found])
                if ready and k is not None and k == now:  # its key's rows share one list
                    old = len(ready[-1][1])
                    ready[-1][1] = np.union1d(ready[-1][1], found)
                    ready[-1][2] += 1
                    total += len(ready[-1][1]) - old
                    continue
                if total >= ENTRIES or len(ready) >= 10_000:
                    yield made(keys, ready)
                    ready, total = [], 0
                now = k
                ready.append([k, found, 1])
                total += len(found)
        if keys is not None and ready:
            yield made(keys, ready)

    def made(keys: pa.Array, ready: list[list]) -> pa.RecordBatch:
        ready = [(k, at) for k, at, times in ready for _ in range(times)]
        edges = np.concatenate([[0], np.cumsum([len(at) for _, at in ready])]).astype(np.int32)
        entries = keys.take(pa.array(np.concatenate([at for _, at in ready]).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in ready], keys.type), pa.ListArray.from_arrays(pa.array(edges), entries)], [key, "dominated_by"])

    kind = df.schema[key].dataType.simpleString()
    return met.mapInArrow(lists, f"`{key}` {kind}, dominated_by array<{kind}>")


def _depths(points: np.ndarray, base: np.ndarray, known: int | None = None) -> np.ndarray:
    """Front number of each of a block's points, in falling order; ``base`` is the least that earlier blocks leave it.

    Whoever is dominated in a front is dominated in all before it, down to its base: were a dominator there in an earlier
    block, the base would be higher. So the front is found by halving. ``known`` and more count as ``known`` or more.
    """
    fronts: list[np.ndarray] = []
    sizes: list[int] = []
    out = np.zeros(len(points), np.int64)
    for k, (p, lo) in enumerate(zip(points, base.tolist())):
        hi = len(fronts)
        while lo < hi:
            mid = (lo + hi) // 2
            if (fronts[mid][: sizes[mid]] >= p).all(axis=1).any():
                lo = mid + 1
            else:
                hi = mid
        out[k] = lo
        if known is not None and lo >= known:
            continue
        while lo >= len(fronts):
            fronts.append(np.empty((8, points.shape[1])))
            sizes.append(0)
        if sizes[lo] == len(fronts[lo]):
            fronts[lo] = np.concatenate([fronts[lo], np.empty_like(fronts[lo])])
        fronts[lo][sizes[lo]] = p
        sizes[lo] += 1
    return out


def _beaten(points: np.ndarray, block: np.ndarray, ranks: np.ndarray, levels: int | None = None) -> np.ndarray:
    """One more than the highest rank of a point of ``block`` that dominates each of ``points``, 0 without one. No point is
    in both. Both are cut into cells at the block's quantiles: a cell that is higher in all objectives dominates whole,
    one that is lower in any not at all, and only between the others are points compared."""
    levels = levels or max(2, min(8, int((len(block) / 30) ** (1 / block.shape[1]))))
    cuts = [np.unique(np.quantile(block[:, j], np.arange(1, levels) / levels)) for j in range(block.shape[1])]
    cell = lambda x: np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)])
    theirs, of = np.unique(cell(block), axis=0, return_inverse=True)
    order = np.lexsort((-ranks, of.ravel()))
    block, ranks, of = block[order], ranks[order], of.ravel()[order]
    begin = np.searchsorted(of, np.arange(len(theirs) + 1))
    highest = ranks[begin[:-1]]
    mine, my = np.unique(cell(points), axis=0, return_inverse=True)
    my = my.ravel()
    out = np.zeros(len(points), np.int64)
    group = np.argsort(my, kind="stable")
    edge = np.searchsorted(my[group], np.arange(len(mine) + 1))
    for c, code in enumerate(mine):
        whole = (theirs > code).all(axis=1)
        best = int(highest[whole].max()) + 1 if whole.any() else 0
        some = np.flatnonzero((theirs >= code).all(axis=1) & ~whole & (highest >= best))
        rows = group[edge[c] : edge[c + 1]]
        got = np.full(len(rows), best)
        for t in some:
            q, r = block[begin[t] : begin[t + 1]], ranks[begin[t] : begin[t + 1]]
            q, r = q[r >= best], r[r >= best]
            for k in range(0, len(rows), max(1, 1_000_000 // len(q))):
                p = points[rows[k : k + max(1, 1_000_000 // len(q))]]
                above = q[None, :, 0] >= p[:, None, 0]
                for j in range(1, points.shape[1]):
                    above &= q[None, :, j] >= p[:, None, j]
                first = above.argmax(axis=1)  # ranks fall, so the first that dominates is the highest
                hit = np.where(above[np.arange(len(p)), first], r[first] + 1, 0)
                got[k : k + len(p)] = np.maximum(got[k : k + len(p)], hit)
        out[rows] = got
    return out


def _settled(points: np.ndarray, base: np.ndarray, known: int | None = None) -> np.ndarray:
    """``_depths`` by halves: the first half's fronts bound those of the second, in cells."""
    if len(points) <= 256:
        return _depths(points, base, known)
    half = len(points) // 2
    first = _settled(points[:half], base[:half], known)
    counts = first < known if known is not None else np.ones(half, bool)
    rest = base[half:]
    if counts.any():
        rest = np.maximum(rest, _beaten(points[half:], points[:half][counts], first[counts]))
    second = rest.copy()
    open_ = rest < known if known is not None else np.ones(len(rest), bool)
    second[open_] = _settled(points[half:][open_], rest[open_], known)
    return np.r_[first, second]


def _ranks(df: DataFrame, names: Sequence[str], part: Sequence[str] = (), known: int | None = None, block: int = BLOCK, against: int = AGAINST) -> DataFrame:
    """(part, objectives, rank): the front of each distinct point within its part, by peeling; with ``known`` only those below.

    A point's front is one more than the last front with a point that dominates it, and in falling order only earlier
    points do. Points that make few chains go along these (``_chained``). Of others, blocks get their fronts one after the
    other, each in one task a part, and all later points are
    held against a block in as many tasks as they ask for: they take over the least front that it leaves them, and go if
    that is not asked for. Rounds are points / ``block``; no step holds more than a block and ``against`` points.
    """
    names, part = list(names), list(part)
    points = _points(df, names, part)
    lead = _lead(points, names, part)
    if lead is not None:
        return _chained(points, names, part, lead, known, SLICE)
    state = _placed(points, names, part, block).withColumn("__base", F.lit(0))
    last = state.agg(F.max("__b")).first()[0]
    schema = state.select(*part, *names).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    matrix = lambda t: np.column_stack([t[o].to_numpy() for o in names])

    def settle(rows: pa.Table) -> pa.Table:
        points = matrix(rows)
        order = np.lexsort((*(-points).T[::-1], -reduce(np.add, list(points.T))))
        ranks = np.empty(len(points), np.int64)
        ranks[order] = _settled(points[order], rows["__base"].to_numpy().astype(np.int64)[order], known)
        return rows.select([*part, *names]).append_column("rank", pa.array(ranks, pa.int32()))

    def hold(rows: pa.Table, block: pa.Table) -> pa.Table:
        base = rows["__base"].to_numpy().astype(np.int64)
        if block.num_rows and rows.num_rows:
            base = np.maximum(base, _beaten(matrix(rows), matrix(block), block["rank"].to_numpy().astype(np.int64)))
        out = rows.select([*part, *names, "__b"]).append_column("__base", pa.array(base, pa.int32()))
        return out if known is None else out.filter(pa.array(base < known))

    found = []
    for b in range((last if last is not None else -1) + 1):
        here = state.where(F.col("__b") == b)
        keys = part or [F.lit(0).alias("__one")]
        ranked = written(here.groupBy(*keys).applyInArrow(settle, f"{fields}, rank int"), "fronts")
        if known is not None:
            ranked = ranked.where(F.col("rank") < known)
        found.append(ranked)
        if b < last:
            rest = state.where(F.col("__b") > b)
            salts = max(1, -(-rest.count() // against))
            mine = rest.withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
            other = ranked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            held = mine.groupBy(*part, "__salt").cogroup(other.groupBy(*part, "__salt")).applyInArrow(hold, f"{fields}, __b int, __base int")
            state = written(held, "points")
    if not found:
        return state.select(*part, *names, F.col("__base").alias("rank"))
    return reduce(DataFrame.unionByName, found)


def front(df: DataFrame, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """The rows of ``df`` that no other dominates; equal rows all stay. A row with a null or NaN objective is dominated by
    none. Each task thins its batches first."""
    names = list(objectives)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.column_stack([batch[o].to_numpy(zero_copy_only=False) for o in names])
            order = np.lexsort((*(-points).T[::-1], -reduce(np.add, list(points.T))))
            points = points[order]
            fresh = np.r_[True, (points[1:] != points[:-1]).any(axis=1)]
            depth = _settled(points[fresh], np.zeros(int(fresh.sum()), np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in points[fresh][depth == 0].T], names)

    whole = df.where(_complete(names))
    few = whole.select(*[F.col(o).cast("double").alias(o) for o in names]).mapInArrow(local, ", ".join(f"`{o}` double" for o in names))
    best = _ranks(few, names, known=1).select(*[F.col(o).alias(f"__{o}") for o in names])
    same = reduce(Column.__and__, [F.col(o).cast("double") == F.col(f"__{o}") for o in names])
    return whole.join(best, same, "left_semi").unionByName(df.where(~F.coalesce(_complete(names), F.lit(False))))


def pareto_fronts(df: DataFrame, key: str, objectives: Sequence[str] = OBJECTIVES, floor: Column | None = None, max_rank: int | None = None, at_once: int = BLOCK) -> DataFrame:
    """``df`` with ``rank`` 0.. by peeling until no row is left; infeasible rows rank after the last feasible front.

    With ``max_rank`` only so many fronts get a rank, feasible ones first (null below). Equal rows share a front; a null
    floor is not met; a row with a null or NaN objective is dominated by none and dominates none, so it is on the first
    front of its kind. ``at_once`` points get their fronts in one task.
    """
    names = list(objectives)
    doubles = [F.col(o).cast("double").alias(o) for o in names]
    left = df.select(*doubles, F.coalesce(floor, F.lit(False)).alias("__ok") if floor is not None else F.lit(True).alias("__ok"))
    found, rank = [], 0
    for ok in (True, False) if floor is not None else (True,):
        if max_rank is not None and rank >= max_rank:
            break
        here = left.where(F.col("__ok") == ok)
        ranks = _ranks(here.where(_complete(names)), names, known=None if max_rank is None else max_rank - rank, block=at_once)
        odd = here.where(~F.coalesce(_complete(names), F.lit(False))).select(*names, F.lit(0).alias("rank")).distinct()
        ranks = written(ranks.unionByName(odd).select(*names, (F.col("rank") + rank).cast("int").alias("rank"), F.lit(ok).alias("__ok")), "fronts")
        found.append(ranks)
        top = ranks.agg(F.max("rank")).first()[0]
        rank = rank if top is None else top + 1
    ranks = reduce(DataFrame.unionByName, found).select(*[F.col(o).alias(f"__{o}") for o in names], "rank", F.col("__ok").alias("__fits"))
    same = reduce(Column.__and__, [F.col(o).cast("double").eqNullSafe(F.col(f"__{o}")) for o in names], (F.coalesce(floor, F.lit(False)) if floor is not None else F.lit(True)) == F.col("__fits"))
    return df.join(ranks, same, "left").drop("__fits", *[f"__{o}" for o in names])


def crowding(df: DataFrame, key: str, part: str = "rank", objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """``df`` with ``crowding``: sum over objectives of the gap between neighbours in a front; ends are infinite.

    Neighbours in value come from running totals over range slices, ties in order of the key. Rows without a front have no
    crowding; a null value counts in no objective.
    """
    long = df.where(F.col(part).isNotNull()).unpivot([key, part], list(objectives), "objective", "v").where("v is not null")
    keys = [part, "objective"]
    near = running(long, keys, ["v", key], {"before": F.col("v")}, "max", alone=True, before=True)
    near = running(near, keys, [F.desc("v"), F.desc(key)], {"after": F.col("v")}, "min", alone=True, before=True)
    ends = long.groupBy(*keys).agg((F.max("v") - F.min("v")).alias("width"))
    before, after, width = F.col("before"), F.col("after"), F.col("width")
    gap = F.when(before.isNull() | after.isNull(), float("inf")).when(width > 0, (after - before) / width).otherwise(0.0)
    return df.join(near.join(ends, keys).select(key, gap.alias("g")).groupBy(key).agg(F.sum("g").alias("crowding")), key, "left")


def select_top(df: DataFrame, k: int, key: str, preference: Sequence[float] | None = None, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """At most ``k`` rows of the first front, by preference or by crowding, ties by key."""
    first = df.where("rank = 0")
    if preference:
        return first.withColumn("composite", composite(objectives, preference)).orderBy(F.desc(F.round("composite", 12)), key).limit(k)
    return first.orderBy(F.desc("crowding"), key).limit(k)


def front_membership(df: DataFrame, key: str, draws: int, seed: int = 0, sigma: float = 0.02, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """(key, p): how often a candidate is on the first front under noise; normal draws from hash bits. All draws are peeled
    side by side, a part each. Rows with a null or NaN objective are passed over (p is 0)."""
    turns = F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "__r"))
    at = lambda o, n: hash_bits(seed, F.col("__r").cast("string"), F.col(key).cast("string"), o, n)
    noise = lambda o: F.sqrt(-2 * F.log(F.greatest(at(o, 1), F.lit(1e-12)))) * F.cos(2 * np.pi * at(o, 2))
    names = list(objectives)
    rows = df.where(_complete(names)).select(key, *names).crossJoin(turns).select(key, "__r", *[clip(F.col(o) + sigma * noise(o)).alias(o) for o in names])
    rows = written(rows, "draws")
    best = _ranks(rows, names, ["__r"], known=1)
    got = rows.join(best, ["__r", *names], "left_semi").groupBy(key).agg((F.count("*") / draws).alias("p"))
    return df.select(key).join(got, key, "left").na.fill(0.0, ["p"])


def floors_report(df: DataFrame, key: str, floors: dict[str, float]) -> DataFrame:
    """One row: candidates, those that pass all floors, and of the misses the closest (objective, id, gap)."""
    passes = reduce(Column.__and__, [F.col(o) >= f for o, f in floors.items()])
    n = df.agg(F.count("*").alias("candidates"), F.sum(passes.cast("long")).alias("passing"))
    gaps = df.select(key, F.explode(F.array(*[F.struct(F.round(F.lit(f) - F.col(o), 12).alias("gap"), F.lit(k).alias("o"), F.lit(o).alias("objective")) for k, (o, f) in enumerate(floors.items())])).alias("g")).where("g.gap > 0")
    near = gaps.agg(F.min(F.struct("g.gap", F.col(key), "g.o", "g.objective")).alias("m"))
    return n.crossJoin(near).select("candidates", "passing", F.col("m.objective").alias("binding"), F.col(f"m.{key}").alias("closest"), F.col("m.gap").alias("gap"), F.when(F.col("passing") == 0, "no candidate passes the floors").alias("reason"))


#: Rows of the longer side of a product that a task takes, and rows of the other side that they meet at a time.
ROWS_A_TASK, TILE = 1_000, 1_000


def _tiles(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """(by, name): rows as they lie, up to TILE neighbours that are equal in ``by`` as one array of structs of all other columns."""
    rest = [c for c in df.columns if c not in by]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.arange(batch.num_rows) % TILE == 0
            for c in by:
                same = pc.equal(batch[c][1:], batch[c][:-1]).fill_null(False)  # nulls are alone: they meet nothing
                fresh[1:] |= ~same.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(fresh)
            rows = pa.ListArray.from_arrays(pa.array(np.r_[at, batch.num_rows].astype(np.int32)), batch[name])
            yield pa.RecordBatch.from_arrays([*[batch[c].take(pa.array(at)) for c in by], rows], [*by, name])

    rows = df.select(*by, F.struct(*rest).alias(name))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by]
    return rows.mapInArrow(pack, ", ".join([*kinds, f"{name} array<{rows.schema[name].dataType.simpleString()}>"]))


def _in_order(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """``df`` by ranges of ``by`` and its own order, ``rows`` rows a task, whatever files and keys it came in."""
    numbered = df.withColumn("__n", F.monotonically_increasing_id())
    return numbered.repartitionByRange(max(1, -(-df.count() // rows)), *by, "__n").sortWithinPartitions(*by, "__n").drop("__n")


def _product(met: DataFrame, fixed: Sequence[str], sides: Sequence[tuple[str, DataFrame]], keep: Callable | None = None) -> DataFrame:
    """``fixed`` and the columns of both ``sides``, tiles of these tables: all pairs of each row's two tiles that ``keep`` holds for, a tile at a time."""
    names = [[c for c in df.columns if c not in fixed] for _, df in sides]
    packed = [name for name, _ in sides]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, other = (batch[name][i].values.flatten() for name in packed)
                n, m = len(one[0]), len(other[0])
                left, right = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
                if keep is not None:
                    held = keep(one[0].take(left), other[0].take(right))
                    left, right = left.filter(held), right.filter(held)
                if len(left):
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(batch[c][i], len(left)) for c in fixed], *[c.take(left) for c in one], *[c.take(right) for c in other]], [*fixed, *names[0], *names[1]])

    kinds = [f"`{c}` {met.schema[c].dataType.simpleString()}" for c in fixed] + [f"`{c}` {df.schema[c].dataType.simpleString()}" for (_, df), some in zip(sides, names) for c in some]
    return met.mapInArrow(product, ", ".join(kinds))


def design_space(promoters: DataFrame, enhancers: DataFrame, guides: DataFrame, target: str = "target") -> DataFrame:
    """Every promoter, enhancer and guide of a target; targets that lack one have no row. Null targets meet nothing.

    What comes out grows with the product of a target's rows. Promoters are spread over tasks by target and row, so that no
    target's product is one task's; enhancers and guides are catalogues and are broadcast. A task's promoters meet enhancers
    by tiles, so that what comes out repeats itself within short reach and columnar files of it stay small.
    """
    others = _tiles(_in_order(enhancers, [target], 100 * ROWS_A_TASK), [target], "__e")
    met = _tiles(_in_order(promoters, [target], ROWS_A_TASK), [target], "__p").join(F.broadcast(others), target).join(F.broadcast(guides), target)
    more = [c for c in guides.columns if c != target]
    out = _product(met.select(target, *more, "__p", "__e"), [target, *more], [("__p", promoters), ("__e", enhancers)])
    return out.select(target, *[c for side in (promoters, enhancers, guides) for c in side.columns if c != target])


def pairs(df: DataFrame, key: str, logic: Sequence[str] = ("AND", "OR")) -> DataFrame:
    """(a, b, logic): unordered pairs of a shortlist of leaders, in as many tasks as the shortlist asks for; it is broadcast.

    A task's leaders meet the others by tiles, as in ``design_space``, so that columnar files of the pairs stay small."""
    a, b = df.select(F.col(key).alias("a")), df.select(F.col(key).alias("b"))
    mine = _tiles(a.repartition(max(1, -(-df.count() // ROWS_A_TASK))), [], "__a")
    met = mine.crossJoin(F.broadcast(_tiles(_in_order(b, ["b"], 100 * ROWS_A_TASK), [], "__b")))
    met = met.withColumn("logic", F.explode(F.array(*[F.lit(x) for x in logic])))
    return _product(met, ["logic"], [("__a", a), ("__b", b)], pc.less).select("a", "b", "logic")


def dossier(targets: DataFrame, layers: Sequence[DataFrame], rules: Sequence[tuple[str, float, str]], key: str = "gene", cuts: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """``targets`` with evidence of every layer, the sum of the rules that hold, verdict and reasons; rules are (SQL, points, text).

    Layers should have a row a key; a gene without a layer has nulls there, and a rule over a null does not hold.
    """
    out = reduce(lambda a, b: a.join(b, key, "left"), layers, targets)
    holds = [F.coalesce(F.expr(s), F.lit(False)) for s, _, _ in rules]
    score = reduce(Column.__add__, [F.when(h, F.lit(float(p))).otherwise(0.0) for h, (_, p, _) in zip(holds, rules)])
    why = F.concat_ws("; ", *[F.when(h, F.lit(t)) for h, (_, _, t) in zip(holds, rules)])
    return out.withColumn("score", score).withColumn("reasons", why).withColumn("verdict", F.when(F.col("score") >= cuts[1], "strong").when(F.col("score") >= cuts[0], "moderate").otherwise("weak"))


def _silenced() -> Column:
    """How far methylation is above BETA_FROM, 0 to 1; below it negative."""
    return (F.col("beta") - BETA_FROM) / (1 - BETA_FROM)


def convergence_score(df: DataFrame, percentile: str, masters: int) -> DataFrame:
    """``df`` with silencing_penalty and convergence_score from percentile, log2fc, master_rank, motif_targets, amp, driver,
    subtype, beta. A null amp counts as 0 and a null beta costs nothing; another null part gives a null score."""
    w = CONVERGENCE
    top = df.agg(F.greatest(F.max("motif_targets"), F.lit(1)).alias("__m"))
    parts = {
        "percentile": F.col(percentile), "log2fc": clip(F.col("log2fc") / FULL_LOG2FC), "master": F.col("master_rank") / max(masters, 1), "targets": F.col("motif_targets") / F.col("__m"),
        "amp": clip(F.coalesce("amp", F.lit(0.0)) / FULL_COPIES), "driver": F.col("driver").cast("double"), "subtype": (F.col("subtype") != "").cast("double")}
    base = reduce(Column.__add__, [w[name] * part for name, part in parts.items()])
    penalty = F.when(F.col("beta") > BETA_FROM, w["silencing"] * clip(_silenced())).otherwise(0.0)
    return df.crossJoin(F.broadcast(top)).withColumn("silencing_penalty", F.round(penalty, 4)).withColumn("convergence_score", F.round(base - penalty, 4)).drop("__m")


def direction_gate(df: DataFrame, roles: DataFrame, direction: str, exceptions: DataFrame | None = None, subtype: str | None = None) -> DataFrame:
    """``df`` with role, status (allow, block, quarantine) and excluded. roles: (gene, role, admissible, status).

    An unknown gene is quarantined; an allowed role asked in another direction is blocked; a blocked one asked in an
    admissible direction is quarantined; an exception (gene, subtype, direction) allows.
    """
    out = df.join(F.broadcast(roles.select("gene", "role", "admissible", F.col("status").alias("__s"))), "gene", "left")
    admissible = F.array_contains("admissible", F.col(direction))
    status = F.when(F.col("role").isNull(), "quarantine").when((F.col("__s") == "allow") & ~admissible, "block").when((F.col("__s") == "block") & admissible, "quarantine").otherwise(F.col("__s"))
    if exceptions is not None and subtype:
        mine = exceptions.where(F.col("subtype") == subtype).select("gene", F.col("direction").alias(direction), F.lit(True).alias("__x"))
        out = out.join(F.broadcast(mine), ["gene", direction], "left")
        status = F.when(F.col("__x"), "allow").otherwise(status)
    return out.withColumn("status", status).withColumn("role", F.coalesce("role", F.lit("unclassified"))).withColumn("excluded", F.col("status") == "block").drop("__s", "__x")


def direction_score(direction: Column) -> Column:
    """Signed components over the weights of those present, from log2fc, amp, del, beta, det, residual; 0 without any."""
    sign = F.when(direction == "repress", 1.0).otherwise(-1.0)
    parts = {
        "log2fc": clip(F.col("log2fc") / FULL_LOG2FC, -1.0), "copies": clip(F.col("amp") / FULL_COPIES) - clip(F.col("del") / FULL_COPIES), "beta": -clip(_silenced()),
        "det": clip((F.col("det") - DET_FROM) / (1 - DET_FROM), -1.0), "residual": clip(F.col("residual") / FULL_RESIDUAL, -1.0)}
    there = {name: F.col("amp").isNotNull() & F.col("del").isNotNull() if name == "copies" else F.col(name).isNotNull() for name in parts}
    top = reduce(Column.__add__, [F.when(there[n], DIRECTION[n] * v).otherwise(0.0) for n, v in parts.items()])
    below = reduce(Column.__add__, [F.when(t, F.lit(DIRECTION[n])).otherwise(0.0) for n, t in there.items()])
    return F.round(sign * F.when(below > 0, top / below).otherwise(0.0), 4)


def role_audit(df: DataFrame, cut: float = 0.1) -> DataFrame:
    """``df`` (amp, del, beta, admissible) with implied direction and verdict against the curated role; without evidence
    the verdict says so."""
    number, silence = clip((F.col("amp") - F.col("del")) / FULL_COPIES, -1.0), -clip(_silenced())
    has_n, has_s = F.col("amp").isNotNull() & F.col("del").isNotNull(), F.col("beta").isNotNull()
    weight = F.when(has_n, ROLE["copies"]).otherwise(0.0) + F.when(has_s, ROLE["beta"]).otherwise(0.0)
    signal = F.when(weight > 0, (F.when(has_n, ROLE["copies"] * number).otherwise(0.0) + F.when(has_s, ROLE["beta"] * silence).otherwise(0.0)) / weight)
    implied = F.when(F.col("signal") > cut, "repress").when(F.col("signal") < -cut, "activate")
    verdict = F.when(F.size("admissible") == 0, "no prediction").when(F.col("signal").isNull(), "no evidence").when(F.col("implied").isNull(), "inconclusive").when(F.array_contains("admissible", F.col("implied")), "corroborated").otherwise("conflict")
    return df.withColumn("signal", signal).withColumn("implied", implied).withColumn("verdict", verdict)
