"""Running totals against a plain walk, in slices of a few rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import intervals, scan, stats
from locusframe.operators.scan import running


@pytest.mark.parametrize("rows", [7, 1000])
def test_running(spark, rows):
    rng = np.random.default_rng(5)
    data = [(None if rng.random() < 0.1 else "abc"[min(2, int(rng.integers(0, 6)))], None if k == 3 else int(k), None if rng.random() < 0.2 else int(rng.integers(-9, 9))) for k in rng.permutation(120)]
    df = spark.createDataFrame(data, "g string, at long, v long")
    want = {}
    for g in {r[0] for r in data}:
        total, most = None, None
        for _, at, v in sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0)):
            if v is not None:
                total, most = (total or 0) + v, v if most is None else max(most, v)
            want[g, at] = total, most
    sums = {(r["g"], r["at"]): r["s"] for r in running(df, ["g"], ["at"], {"s": F.col("v")}, rows=rows).collect()}
    tops = {(r["g"], r["at"]): r["s"] for r in running(df, ["g"], ["at"], {"s": F.col("v")}, "max", rows).collect()}
    assert sums == {k: v[0] for k, v in want.items()} and tops == {k: v[1] for k, v in want.items()}
    assert running(df.limit(0), ["g"], ["at"], {"s": F.col("v")}).count() == 0
    assert running(df, [], ["at"], {"s": F.lit(1)}, rows=rows).agg(F.max("s")).first()[0] == 120


@pytest.fixture(params=[None, 40])
def slices(request, monkeypatch):
    """As tables are, and in slices of a few rows."""
    if request.param:
        monkeypatch.setattr(scan, "ROWS", request.param)
        monkeypatch.setattr(scan, "ALONE", 0)


def test_merge_and_pile_up(spark, slices):
    rng = np.random.default_rng(2)
    reads = [("c" if k % 3 else None, int(s), int(s + w)) for k, (s, w) in enumerate(zip(rng.integers(0, 4000, 300), rng.integers(1, 60, 300)))] + [("c", 100, 2500), ("d", 5, 9), ("d", 9, 12), ("d", 13, 14), ("d", None, 4)]
    df = spark.createDataFrame(reads, "chrom string, start_pos long, end_pos long")
    want = []
    for chrom in (None, "c", "d"):
        at = None
        for s, e in sorted((s, e) for c, s, e in reads if c == chrom and s is not None):
            if at is None or s > at[2]:
                at = [chrom, s, e, 0]
                want.append(at)
            at[2], at[3] = max(at[2], e), at[3] + 1
    got = [tuple(r) for r in intervals.merge_intervals(df).collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)
    regions = spark.createDataFrame([(1, "c", 50, 400), (2, "c", 300, 1900), (3, "d", 0, 100), (4, "e", 0, 9), (None, "c", 0, 100)], "id long, chrom string, start_pos long, end_pos long")
    depth = {}
    for i, c, a, b in [(1, "c", 50, 400), (2, "c", 300, 1900), (3, "d", 0, 100)]:
        for chrom, s, e in reads:
            for p in range(max(a, s), min(b, e)) if chrom == c and s is not None else ():
                depth[i, p] = depth.get((i, p), 0) + 1
    assert {(r["id"], r["pos"]): r["depth"] for r in intervals.coverage(df, regions, "id", per_base=True).collect()} == depth
    runs = sorted(tuple(r) for r in intervals.coverage_runs(df, regions, "id").collect())
    assert all(a[0] != b[0] or a[2] < b[1] or a[2] == b[1] and a[3] != b[3] for a, b in zip(runs, runs[1:]))
    assert intervals.coverage_runs(df.limit(0), regions, "id").count() == 0 and intervals.merge_intervals(df.limit(0)).count() == 0


def test_ranks(spark, slices):
    rng = np.random.default_rng(6)
    rows = [(str(rng.integers(0, 2)), None if k % 17 == 0 else float(rng.integers(0, 40)), int(rng.integers(0, 2)), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, y int, id long")
    got = {r["id"]: r["rank"] for r in stats.avg_rank(df, "v", ["g"]).collect()}
    for g, v, _, k in rows:
        mine = [x for h, x, _, _ in rows if h == g and x is not None]
        assert got[k] == (None if v is None else sum(x < v for x in mine) + (sum(x == v for x in mine) + 1) / 2)
    auc = {r["g"]: r["auroc"] for r in stats.auroc(df, "y", "v", ["g"]).collect()}
    for g in "01":
        pairs = [(a > b) + (a == b) / 2 for h, a, y, _ in rows if h == g and y and a is not None for i, b, z, _ in rows if i == g and not z and b is not None]
        assert abs(auc[g] - sum(pairs) / len(pairs)) < 1e-12


@pytest.mark.parametrize("bin_rows", [11, 50_000])
def test_smallest_hashes(spark, bin_rows):
    df = spark.range(200)
    for k in (0, 1, 37, 200, 300):
        got = stats.smallest_hashes(df, "id", spark.createDataFrame([(k,)], "k long"), 5, 9, bin_rows)
        want = {(r, i) for r in range(5) for i in sorted(range(200), key=lambda i: hashlib.sha256(f"9:{r}:{i}".encode()).hexdigest())[:k]}
        assert {tuple(x) for x in got.collect()} == want


def test_spaced_picks_on_ties(spark):
    rows = [("c", int(s), int(s) + w, 1.0) for s in np.random.default_rng(4).integers(0, 900, 400) for w in (5, 9)] + [("d", 3, 4, 2.0), (None, 1, 2, 3.0)]
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, signal double")
    want = []
    for chrom, start, end, signal in sorted((r for r in set(rows) if r[0]), key=lambda r: (-r[3], *r[:3])):
        mine = [w for w in want if w[0] == chrom]
        if len(mine) < 4 and all(abs(start - w[1]) >= 50 for w in mine):
            want.append((chrom, start, end, signal))
    assert sorted(tuple(r) for r in intervals.spaced_topk(df, "chrom", 50, 4).collect()) == sorted(want)
