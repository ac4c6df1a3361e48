"""Operators whose sample or switch must not show in the result."""

import numpy as np

from locusframe.llm import packing, toxicity
from tests.llm.conftest import prose


def test_toxicity_of_a_sample_is_that_of_all_rows(spark):
    rows = [(k, prose(12, k) + (" vile slur" if k % 10 == 0 else ""), int(k % 10 == 0)) for k in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    texts = ["", None, prose(12, 5000), prose(12, 5001), prose(12, 5002) + " vile slur", "vile slur"]
    full, part = (toxicity.fit_toxicity(docs, labels, per_class=n).score(texts) for n in (10_000, 60))
    assert ((full >= 0.5) == (part >= 0.5)).all()
    assert list(full >= 0.5) == [False] * 4 + [True] * 2
    odds = lambda p: np.log(p / (1 - p))
    assert abs(odds(full) - odds(part))[0] < 0.5


def test_many_sources_keep_targets_and_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    sources = [f"s{k}" for k in range(12)]
    rows = [(1000 * k + d, prose(20, 100 * k + d), s) for k, s in enumerate(sources) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1).sortWithinPartitions("doc_id")
    pieces = packing.pack(docs, {"s0": 0.75, "s1": 0.25}, capacity=64).collect()
    early = [r for r in pieces if r["sequence_id"] < 10]
    count = {q: sum(r["length"] for r in early if r["queue"] == q) for q in {r["queue"] for r in early}}
    assert abs(count["=s0"] - 480) <= 4 and abs(count["=s1"] - 160) <= 4 and sum(count.values()) == 640
    ends = {}
    for r in pieces:
        ends[r["doc_id"]] = ends.get(r["doc_id"], 0) + r["length"]
    assert set(ends) == {r[0] for r in rows} and all(ends[r["doc_id"]] == r["doc_tokens"] for r in pieces)
    pieces = packing.pack(docs, capacity=64).collect()
    last = max(r["sequence_id"] for r in pieces)
    assert sorted((r["sequence_id"], r["offset"]) for r in pieces)[0] == (0, 0)
    half = [r for r in pieces if r["sequence_id"] < last / 2]
    for k in range(len(sources)):  # halfway, every source is halfway, give or take two documents
        mine = [r for r in pieces if r["doc_id"] // 1000 == k]
        seen = sum(r["length"] for r in half if r["doc_id"] // 1000 == k)
        assert abs(seen - sum(r["length"] for r in mine) / 2) < 2 * max(r["doc_tokens"] for r in mine)
