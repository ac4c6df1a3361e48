"""Window sweeps, leave-one-out and caliper matching against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import chromatin, scan
from tests.test_whole import plain_match


@pytest.mark.parametrize("segment", [None, 6])
def test_matching_on_chains(spark, segment):
    gaps = [1 / (1 + k / 40) for k in range(40)]  # each score's nearest is the next one
    chain, at = [], 0.0
    for k, g in enumerate(gaps):
        chain.append((f"g{k:03d}", k % 3 == 0, at))
        at += g
    far = [(f"h{k}", k % 2 == 0, 500.0 + 90 * (k // 2)) for k in range(8)]
    ties = [(f"k{k}", k % 4 == 0, 1000.0 + k // 6) for k in range(24)] + [("null", True, None), ("nan", True, math.nan), ("odd", None, 3.0)]
    rows = chain + far + ties
    df = spark.createDataFrame(rows, "gene string, t boolean, s double")
    real = [r for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2]]
    sd = float(np.std([r[2] for r in real]))
    for caliper in (0.0005, 0.004):
        got = sorted((r[0], r[1], round(r[2], 9)) for r in chromatin.caliper_match(df, "t", "s", "gene", caliper, segment=segment).collect())
        assert got == plain_match(real, caliper * sd, 3)


def test_calipers_side_by_side(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{k}", bool(k % 7 == 0), float(rng.normal()), float(rng.integers(0, 30))) for k in range(150)]
    df = spark.createDataFrame(rows, "gene string, t boolean, s double, v double")
    got = {r["caliper"]: r for r in chromatin.caliper_sweep(df, "t", "v", "s", "gene", [0.02, 0.2]).collect()}
    value = {r[0]: r[3] for r in rows}
    for c, r in got.items():
        one = [value[m] for _, m, _ in plain_match([x[:3] for x in rows], c * float(np.std([x[2] for x in rows])), 3)]
        mine = [x[3] for x in rows if x[1]]
        assert r["n_matched"] == len(one) and abs(r["matched_mean"] - np.mean(one)) < 1e-9
        assert r["u"] == sum((a > b) + (a == b) / 2 for a in mine for b in one)


@pytest.mark.parametrize("rows", [None, 30])
def test_window_means(spark, monkeypatch, rows):
    if rows:
        monkeypatch.setattr(scan, "ROWS", rows)
        monkeypatch.setattr(scan, "ALONE", 0)
    rng = np.random.default_rng(9)
    records = [(["a", "b"][k % 2], "c" if k % 5 else "d", int(s), int(s + w), None if k % 11 == 0 else math.nan if k % 13 == 0 else float(1e6 + rng.normal())) for k, (s, w) in enumerate(zip(rng.integers(0, 600, 200), rng.integers(0, 30, 200)))]
    loci = [(k, "c" if k % 3 else "d", int(rng.integers(0, 600))) for k in range(25)] + [(90, "e", 5), (91, None, 5), (92, "c", None)]
    t = spark.createDataFrame(records, "track string, chrom string, start_pos long, end_pos long, value double")
    df = spark.createDataFrame(loci, "id long, chrom string, tss long")
    got = {(r["id"], r["width"], r["track"]): (r["mean"], r["n"]) for r in chromatin.signal_means(df, t, [3, 40], "id").collect()}
    assert len(got) == 26 * 2 * 2
    for (k, w, track), (mean, n) in got.items():
        chrom, at = next(x[1:] for x in loci if x[0] == k)
        mine = [v for tr, c, s, e, v in records if tr == track and c == chrom and v is not None and v == v and s < e and s < at + w and e > at - w]
        assert n == len(mine) and (mean is None if not mine else abs(mean - np.mean(mine)) < 1e-6)


def test_leave_one_out(spark):
    rng = np.random.default_rng(1)
    rows = [(k, bool(k % 6 == 0), float(rng.integers(0, 9))) for k in range(60)] + [(60, None, 1.0), (61, True, None), (62, False, None)]
    got = {r["dropped"]: r for r in chromatin.leave_one_out(spark.createDataFrame(rows, "id long, t boolean, v double"), "t", "v", "id").collect()}
    back = [v for _, t, v in rows if t is False and v is not None]
    ps = {}
    for k, t, v in rows:
        if t and v is not None:
            mine = [x for i, s, x in rows if s and x is not None and i != k]
            u = sum((a > b) + (a == b) / 2 for a in mine for b in back)
            n1, n2, both = len(mine), len(back), mine + back
            n = n1 + n2
            ties = sum(both.count(x) ** 3 - both.count(x) for x in set(both))
            z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
            ps[k] = 0.5 * math.erfc(z / math.sqrt(2))
            assert got[k]["u"] == u and abs(got[k]["p"] - ps[k]) < 1e-12 and abs(got[k]["mean"] - np.mean(mine)) < 1e-12
    assert set(got) == set(ps) and all(abs(r["worst"] - max(ps.values())) < 1e-12 for r in got.values())
    alone = chromatin.leave_one_out(spark.createDataFrame([(1, True, 2.0), (2, False, 1.0)], "id long, t boolean, v double"), "t", "v", "id").collect()
    assert [r["p"] for r in alone] == [None] and chromatin.leave_one_out(spark.createDataFrame(rows, "id long, t boolean, v double").where(F.lit(False)), "t", "v", "id").count() == 0
