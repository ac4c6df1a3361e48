"""Operators that loop, held against plain versions that run to the end."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import chromatin, rank
from locusframe.plans import catalog


def plain_match(rows, width, m):
    t = [(s, k) for k, on, s in rows if on and s is not None]
    b = [(s, k) for k, on, s in rows if not on and s is not None]
    used, have, out = set(), {}, []
    for gap, _, _, x, y in sorted((abs(ts - bs), ts, bs, x, y) for ts, x in t for bs, y in b if abs(ts - bs) <= width):
        if y not in used and have.get(x, 0) < m:
            used.add(y)
            have[x] = have.get(x, 0) + 1
            out.append((x, y, round(gap, 9)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["tied", "spread", "scarce"])
def test_caliper_match_runs_until_no_pair_is_left(spark, kind):
    draw = random.Random(5)
    score = {"tied": lambda: draw.randrange(4) / 4, "spread": draw.random, "scarce": lambda: draw.randrange(40) / 8}[kind]
    share = 0.5 if kind == "scarce" else 0.2
    rows = [(f"G{k:03}", draw.random() < share, score()) for k in range(160)] + [("N1", True, None), ("N2", False, None)]
    df = spark.createDataFrame(rows, "gene string, t boolean, s double")
    width = 0.3 * df.agg(F.stddev_pop("s")).first()[0]
    got = sorted((r[0], r[1], round(r[2], 9)) for r in chromatin.caliper_match(df, "t", "s", "gene", 0.3).collect())
    assert got == plain_match(rows, width, 3)


def plain_fronts(rows):
    out, left, k = {}, dict(rows), 0
    while left:
        top = [i for i, p in left.items() if not any(all(x >= y for x, y in zip(q, p)) and q != p for q in left.values())]
        out |= dict.fromkeys(top, k)
        left = {i: p for i, p in left.items() if i not in top}
        k += 1
    return out


@pytest.mark.parametrize("at_once", [200_000, 60, 25])
def test_every_row_gets_a_front(spark, at_once):
    draw = random.Random(3)
    rows = [(k, *(draw.randrange(8) / 8 for _ in rank.OBJECTIVES)) for k in range(150)]
    df = spark.createDataFrame(rows, ["id", *rank.OBJECTIVES])
    want = plain_fronts([(r[0], r[1:]) for r in rows])
    assert max(want.values()) > 4
    got = {r["id"]: r["rank"] for r in rank.pareto_fronts(df, "id", at_once=at_once).collect()}
    assert got == want
    if at_once > 60:
        good = plain_fronts([(r[0], r[1:]) for r in rows if r[4] >= 0.5])
        bad = plain_fronts([(r[0], r[1:]) for r in rows if r[4] < 0.5])
        got = {r["id"]: r["rank"] for r in rank.pareto_fronts(df, "id", floor=F.col("safety") >= 0.5).collect()}
        assert got == good | {k: x + max(good.values()) + 1 for k, x in bad.items()}


def test_pile_up_covers_every_locus(spark):
    sf = "/root/testdata/sf0.001"
    depth = {r["locus_id"]: r["depth"] for r in catalog.QUERIES["j10_coverage"](spark, sf).collect()}
    bases = {r["locus_id"]: r["d"] for r in catalog.QUERIES["j10_coverage_per_base"](spark, sf).groupBy("locus_id").agg(F.sum("depth").alias("d")).collect()}
    assert {k for k in bases if k % 20}
    assert {k: round(x / 2000, 6) for k, x in bases.items()} == {k: x for k, x in depth.items() if x}
