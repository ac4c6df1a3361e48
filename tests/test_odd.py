"""Queries against their SQL on values that the driver's small tables lack."""

import math

import duckdb

from locusframe.plans.catalog import QUERIES, SQL


def test_padded_vectors_keep_the_sign_of_zero(spark, tmp_path):
    rows = [(1, [-1e-7, -0.0, 0.0, 1e-7, -0.0000005, 0.0234375, *[0.25] * 58]), (2, [0.5] * 64), (3, [-4e-7] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    signed = lambda rows: sorted((k, [(v, math.copysign(1, v)) for v in x]) for k, x in rows)
    got = signed(tuple(r) for r in QUERIES["w8_pad_zero_vector"](spark, str(tmp_path)).select("vec_id", "x").collect())
    assert got == signed(con.execute(SQL["w8_pad_zero_vector"]).fetchall())


def test_nearest_sequences_of_all_lengths_meet_in_one_pass(spark, monkeypatch):
    from locusframe.operators import seq

    texts = [(n, "".join("ACGTÉN"[(n * 31 + i * i * 7 + i // 3) % (6 if n % 4 == 0 else 4)] for i in range(1 + n * 13 % 300))) for n in range(60)] + [(90, ""), (91, None), (None, "ACGT")]
    df = spark.createDataFrame(texts, "id long, s string")
    full = [(k, s) for k, s in texts if k is not None and s]
    plain = []
    for k, s in full:
        if k % 3 == 0:
            shares = [(-round(sum(a == b for a, b in zip(s, t)) / min(len(s), len(t)), 9), r) for r, t in full if r != k]
            plain.append((k, min(shares)[1], -min(shares)[0]))
    passes = []
    one = seq._nearest
    monkeypatch.setattr(seq, "_nearest", lambda *a: passes.append(1) or one(*a))
    for room in (1 << 20, 3000):
        monkeypatch.setattr(seq, "QUERY_BYTES", room)
        got = sorted((r["id"], r["nearest"], round(r["identity"], 9)) for r in seq.nn_identity(df.where("id % 3 = 0"), df.repartition(3), "s", "id", loo=True).collect())
        assert got == sorted(plain)
        assert room == 3000 or len(passes) == 1


def test_scores_of_hits_come_from_arrays(spark):
    from locusframe.operators import offtarget as ot

    w = "ACGTACGTTGCATGCAACGT"
    pairs = [(w, w), (w, "C" + w[1:]), (w, w[:5] + "AA" + w[7:]), (w, w[::-1]), (w[:7], w), ("", w), ("", ""), (None, w), (w, None), ("É" + w[1:], "É" + w[1:19] + "G"), (w.lower(), w)]
    df = spark.createDataFrame([(n, a, b, "AGG") for n, (a, b) in enumerate(pairs)], "n int, guide string, site string, pam string")
    weights = spark.createDataFrame([(f"{a}{b}{i}", i / 20) for a in "ACGT" for b in "ACGT" if a != b for i in range(1, 21) if (a, i) != ("G", 3)], "key string, weight double")
    scored = ot.cfd(df.withColumn("style", ot.cfd_style("guide", "site", "pam")).withColumn("mit", ot.mit_score("guide", "site")), weights, spark.createDataFrame([("GG", 1.0)], "pam string, weight double"))
    text = scored._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in text and "zip_with(" not in text
    for r in scored.collect():
        a, b = pairs[r.n]
        if a is None or b is None:
            assert (r.style, r.mit, r.cfd) == (None, None, 0.0)
            continue
        bad = [i for i, (x, y) in enumerate(zip(a or [""], b or [""])) if x != y]
        style, exact = 1.0, 1.0
        for i in bad:
            style *= 1.0 - ot.POSITION_PENALTY[i]
        for i, (x, y) in enumerate(zip(a.upper(), b.upper())):
            exact *= 1.0 if x == y else 0.0 if x not in "ACGT" or y not in "ACGT" or (x, i) == ("G", 2) else (i + 1) / 20
        near = 1 / ((19 - (bad[-1] - bad[0]) / (len(bad) - 1)) / 19 * 4 + 1) if len(bad) > 1 else 1.0
        assert (r.style, r.mit) == (style, style * near / len(bad) ** 2 if bad else 1.0)
        assert r.cfd == (exact if len(a) >= 20 and len(b) >= 20 else 0.0)


def test_pile_up_is_made_once_a_chromosome(spark, monkeypatch):
    from locusframe.operators import intervals

    reads = [(f"c{n % 2}", 7 * n % 300, 7 * n % 300 + n % 23) for n in range(400)] + [(None, 1, 50), ("c1", None, 50), ("c0", 20, 20)]
    regions = [(n, f"c{n % 2}", 11 * n % 290, 11 * n % 290 + 5 + n % 40) for n in range(40)] + [(1, "c1", 0, 60), (1, "c0", 30, 90), (2, "c0", 0, 400), (None, "c0", 0, 9), (77, "c9", 0, 9), (78, "c0", 9, 9)]
    seen = []
    join = intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b, *r, **k: seen.append(b) or join(a, b, *r, **k))
    df = lambda rows, key="": spark.createDataFrame(rows, f"{key}chrom string, start_pos long, end_pos long")
    got = {(r["key"], p): r["depth"] for r in intervals.coverage_runs(df(reads), df(regions, "key long, "), "key").collect() for p in range(r["start_pos"], r["end_pos"])}
    want = {}
    for k, c, a, b in regions:
        for chrom, s, e in reads:
            for p in range(max(a, s), min(b, e)) if k is not None and chrom == c and s is not None else ():
                want[k, p] = want.get((k, p), 0) + 1
    assert got == want
    # What meets the regions is runs that do not overlap, not reads.
    met = sorted(tuple(r) for r in seen[0].select("chrom", "start_pos", "end_pos").collect())
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(met, met[1:]))


def test_maxima_over_overlaps_make_no_pairs(spark, monkeypatch):
    from locusframe.operators import intervals

    places = [(n, f"c{n % 2}", 10 * n % 97 - 20, 10 * n % 97 - 20 + n % 30) for n in range(60)] + [(90, None, 1, 9), (91, "c0", None, 9), (92, "c9", 1, 5), (5, "c1", 3, 80), (None, "c1", 3, 80)]
    records = [(f"c{n % 2}", 37 * n % 131 - 25, 37 * n % 131 - 25 + n * n % 12, None if n % 17 == 0 else (n * 7919 % 101) - 50.0) for n in range(60)] + [(None, 1, 50, 99.0), ("c1", None, 50, 99.0), ("c0", 3, 3, 99.0), ("c0", -40, 60, None)]
    b = spark.createDataFrame(records, "chrom string, start_pos long, end_pos long, value double")
    a = lambda rows: spark.createDataFrame(rows, "key long, chrom string, start_pos long, end_pos long")
    meets = lambda p, r: None not in (*p, *r[:3]) and p[1] == r[0] and p[2] < r[2] and p[3] > r[1]

    def check(places, records, b):
        over = {p[0]: [r[3] for q in places if q[0] == p[0] for r in records if meets(q, r)] for p in places}
        want = sorted(((p[0], max([v for v in over[p[0]] if v is not None], default=0.0), bool(over[p[0]])) for p in places), key=repr)
        got = intervals.overlap_max(a(places), b, "value", "key", flag="hit").select("key", "best", "hit").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want and sum(w[2] for w in want) > 20

    check(places, records, b)
    monkeypatch.setattr(intervals, "overlap_join", None)
    check([p for p in places if p[2] is None or p[2] < p[3]], [r for r in records if r[1] is None or r[1] < r[2]], b.where("start_pos is null or start_pos < end_pos"))


def test_grid_points_are_spread_over_tasks(spark, monkeypatch):
    from locusframe.operators import matrix
    from tests.compare import rows

    monkeypatch.setattr(matrix, "ROWS_A_TASK", 50)
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{sf}/part.parquet'")
    for name in ("m15_grid_search", "t21_selection_aware_p"):
        got = QUERIES[name](spark, sf)
        assert "RoundRobinPartitioning(4)" in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got.toPandas()) == rows(con.execute(SQL[name]).df())
