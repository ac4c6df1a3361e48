"""Blocked coexpression and the stateless once-per-id sink against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import graph
from locusframe.streaming import streams


@pytest.mark.parametrize("genes,samples", [(256, 4096), (4, 7)])
def test_coexpression_with_missing_samples(spark, genes, samples):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 30))
    rows = [(f"g{g:02d}", f"s{s}", float(1e4 + base[g % 3, s] + 0.6 * rng.normal())) for g in range(13) for s in range(30) if rng.random() < 0.7]
    rows += [("flat", f"s{s}", 5.0) for s in range(30)] + [("one", "s1", 2.0), ("none", "s2", None), ("nan", "s3", float("nan")), (None, "s1", 1.0), ("g00", None, 1.0), ("g01", "twice", 3.0), ("g01", "twice", 5.0), ("g02", "twice", 9.0)]
    cells = {}
    for g, s, v in rows:
        if g and s and v is not None and v == v:
            cells.setdefault((g, s), []).append(v)
    cells = {k: float(np.mean(v)) for k, v in cells.items()}
    names, want = sorted({g for g, _ in cells}), {}
    for a in names:
        for b in names:
            both = [s for g, s in cells if g == a and (b, s) in cells]
            x, y = np.array([cells[a, s] for s in both]), np.array([cells[b, s] for s in both])
            if a != b and len(both) > 1 and x.std() > 0 and y.std() > 0 and abs(r := np.corrcoef(x, y)[0, 1]) > 0.4:
                want[a, b] = (round(abs(r), 6), int(np.sign(r)))
    df = spark.createDataFrame(rows, "gene string, sample string, value double")
    got = {(r["src"], r["dst"]): (round(r["weight"], 6), r["sign"]) for r in graph.coexpression_edges(df, 0.4, genes, samples).collect()}
    assert len(want) > 20 and got == want
    assert graph.coexpression_edges(df.where(F.lit(False)), 0.4).count() == 0


def test_once_per_id_without_state(spark, tmp_path):
    out, schema = {}, "example_id string, n long"
    once = streams.OncePerId(f"file://{tmp_path}/ids", "example_id", lambda df, b: out.__setitem__(b, sorted((r["example_id"] or "", r["n"]) for r in df.collect())))
    batches = [[("a", 1), ("b", 2), (None, 3)], [("b", 9), ("c", 4)], [("a", 9), (None, 9), ("d", 5), ("c", 9)], []]
    for k, rows in enumerate(batches):
        once(spark.createDataFrame(rows, schema), k)
    want = {0: [("", 3), ("a", 1), ("b", 2)], 1: [("c", 4)], 2: [("d", 5)], 3: []}
    assert out == want
    once(spark.createDataFrame(batches[1], schema), 1)  # a replay after a failure gives the same rows
    once(spark.createDataFrame(batches[2], schema), 2)
    assert out == want
    ids = spark.read.parquet(f"file://{tmp_path}/ids")
    assert ids.count() == 5 and set(ids.columns) == {"example_id", "batch"}  # an id once, whatever the rows hold


def test_arriving_windows_hold_no_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", "locus_train", "s", "g", "2020"), ("b", "locus_test", "s", "g", "2020")], "example_id string, split string, study string, sample_group string, released string")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    once = streams.OncePerId(f"file://{tmp_path}/ids", "example_id", lambda df, b: seen.extend(r["example_id"] for r in df.collect()))
    q = streams.arriving_windows(spark, f"{tmp_path}/in", rows.schema)
    streams.run_once(q, f"{tmp_path}/ck", "append", once)
    rows.withColumn("released", F.lit("2021")).write.mode("append").parquet(f"{tmp_path}/in")
    query = streams.run_once(q, f"{tmp_path}/ck", "append", once)
    assert sorted(seen) == ["a", "b"]
    assert all(not p["stateOperators"] for p in query.recentProgress)
