"""Closed-form and published values."""

import math

import numpy as np
from pyspark.sql import functions as F

from locusframe.operators import chromatin, evaluate, intervals, offtarget, rank, seq, stats, windows


def test_fronts_and_crowding(spark):
    df = spark.createDataFrame([("A", .9, .9, .9, .9), ("B", .8, 1., .8, .8), ("C", .7, .7, .7, .7), ("D", .6, .6, .6, .6), ("E", .75, .65, .7, .7)], ["id", *rank.OBJECTIVES])
    got = {r["id"]: r["rank"] for r in rank.pareto_fronts(df, "id").collect()}
    assert got == {"A": 0, "B": 0, "C": 1, "E": 1, "D": 2}
    one = spark.createDataFrame([(k, e, .5, .5, .5) for k, e in enumerate((.2, .5, 1.0))], ["id", *rank.OBJECTIVES]).withColumn("rank", F.lit(0))
    assert {r["id"]: r["crowding"] for r in rank.crowding(one, "id", objectives=("efficacy",)).collect()} == {0: math.inf, 1: 1.0, 2: math.inf}


def test_exact_permutation(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(1, 5)], ["k", "x", "y"])
    assert abs(stats.exact_permutation_p(df, "x", "y", "k").first()[0] - 1 / 24) < 1e-12


def test_conformal_order_statistic(spark):
    df = spark.createDataFrame([(float(s),) for s in range(1, 101)], ["s"])
    assert stats.conformal_radius(df, "s", 0.9).first()[0] == 91


def test_group_conformal(spark):
    cal = spark.createDataFrame([(g, 1.0, 1.0 + e, True) for g, e in (("a", .1), ("b", .2), ("c", .3)) for _ in range(2)], ["grp", "target", "prediction", "mask"])
    assert abs(evaluate.group_conformal(cal, cal, 0.9).first()["radius"] - 0.3) < 1e-9


def test_chromatin_state(spark):
    df = spark.createDataFrame([("x", "H3K4me3", 5.0), ("x", "H3K27ac", 3.0)], ["locus", "mark", "level"])
    assert chromatin.mark_levels(df, "locus").select(chromatin.chromatin_state()).first()[0] == "active_promoter"


def test_paired_delta(spark):
    schema = "chrom string, start_pos int, end_pos int, target array<double>, valid array<boolean>"
    ok = [True] * 4
    ref = spark.createDataFrame([("c", 0, 4, [1., 2., 3., 4.], ok), ("c", 4, 8, [2., 2., 2., 2.], ok)], schema)
    trt = spark.createDataFrame([("c", 0, 4, [2., 1., 5., 4.], ok), ("c", 4, 8, [3., 1., 2., 4.], ok)], schema)
    got = [r["delta"] for r in windows.pair_windows(ref, trt).orderBy("start_pos").collect()]
    assert got == [[1., -1., 2., 0.], [1., -1., 0., 2.]]


def test_planted_sites(spark):
    g = "GACGTTACCAGTTAGACCAT"
    near = g[:5] + "A" + g[6:]
    text = "TTTT" + g + "AGG" + "TTTT"
    back = "TTTT" + g.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    back = "TTTT" + "CCA" + back[4:] + "TTTT"
    chunks = spark.createDataFrame([("p", 0, text), ("m", 0, back), ("n", 0, "TTTT" + near + "TGGTTTT"), ("no", 0, "TTTT" + g + "AAATTTT"), ("short", 0, "ACG")], ["chrom", "chunk_start", "seq"])
    guides = spark.createDataFrame([(g,)], ["guide"])
    hits = {(r["chrom"], r["pos"], r["strand"], r["mismatches"]) for r in offtarget.offtargets(chunks, guides, 1).collect()}
    assert hits == {("p", 4, "+", 0), ("m", 4, "-", 0), ("n", 4, "+", 1)}
    seeded = offtarget.offtargets_seeded(offtarget.sites(chunks, "seq", "chrom"), guides, 1)
    assert {(r["chrom"], r["pos"], r["strand"], r["mismatches"]) for r in seeded.collect()} == hits


def test_mit_perfect_match(spark):
    g = "GACGTTACCAGTTAGACCAT"
    df = spark.createDataFrame([(g, g, "AGG")], ["guide", "site", "pam"])
    assert df.select(offtarget.mit_score("guide", "site"), offtarget.cfd_style("guide", "site", "pam")).first()[:] == (1.0, 1.0)


def test_merge_takes_touching_and_overlap_does_not(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 20, 30)], ["chrom", "start_pos", "end_pos"])
    assert sorted((r[1], r[2]) for r in intervals.merge_intervals(df).collect()) == [(0, 9), (20, 30)]
    assert intervals.merge_intervals(df.limit(0)).count() == 0
    other = spark.createDataFrame([("c", 9, 20)], ["chrom", "start_pos", "end_pos"])
    assert intervals.overlap_join(df, other).count() == 0


def test_tails(spark):
    from locusframe.functions.tails import fisher_greater, normal_tail, student_tail

    r = spark.createDataFrame([(1.959963984540054, 2.2281388519649385, 10.0, 3, 1, 1, 3)], ["z", "t", "df", "a", "b", "c", "d"]).select(normal_tail("z"), student_tail("t", "df"), fisher_greater("a", "b", "c", "d")).first()
    assert abs(r[0] - 0.025) < 1e-9 and abs(r[1] - 0.025) < 1e-9 and abs(r[2] - 17 / 70) < 1e-9


def test_pwm_planted(spark):
    pwm = {"T": np.array([[2.0, -1, -1, -1], [-1, 2.0, -1, -1], [-1, -1, 2.0, -1], [-1, -1, -1, 2.0], [2.0, -1, -1, -1]])}
    df = spark.createDataFrame([("hit", "TTTTACGTATTT"), ("none", "GGGGGGG"), ("empty", ""), ("short", "AC")], ["id", "seq"])
    got = {r["id"]: r["score"] for r in seq.pwm_best(pwm, df, "seq", "id").collect()}
    assert got["hit"] == 1.0 and got["none"] < 1 and got["empty"] == 0 and got["short"] == 0


def test_constant_columns_have_no_correlation(spark):
    rows = spark.createDataFrame([(k % 2, 1.0 if k % 2 else float(k), 2.0, k) for k in range(12)], "g int, x double, y double, k int")
    got = {r["g"]: r["r"] for r in rows.groupBy("g").agg(stats.pearson("x", "k").alias("r")).collect()}
    assert got[1] is None and abs(got[0] - 1) < 1e-12
    assert rows.agg(stats.pearson("x", "y").alias("r")).first()["r"] is None
    assert rows.limit(0).agg(stats.pearson("x", "y").alias("r")).first()["r"] is None
    assert stats.partial_spearman(rows, "x", "k", "y").first()[0] is None
    assert stats.residual_spearman(rows, "x", "k", ["y"]).first()["n"] == 12
    from locusframe.operators.graph import coexpression_edges

    genes = spark.createDataFrame([(f"s{k}", g, v) for k in range(5) for g, v in (("a", float(k)), ("b", 1.0), ("c", -2.0 * k))], "sample string, gene string, value double")
    assert sorted((r["src"], r["dst"], r["sign"]) for r in coexpression_edges(genes, 0.5).collect()) == [("a", "c", -1), ("c", "a", -1)]


def test_replicates_that_draw_nothing_are_passed_over(spark):
    few = spark.createDataFrame([(k, float(k), int(k < 2), k * 2.0) for k in range(4)], "k int, v double, y int, s double")
    r = stats.bootstrap_ci(few, "v", "k", 200).first()
    assert r["estimate"] == 1.5 and r["lo"] <= 1.5 <= r["hi"] and 150 < r["used"] <= 200
    r = stats.bootstrap_auc(few, "y", "v", "s", "k", 60).first()
    assert r["auc_a"] == 0.0 and 0 < r["used"] <= 60
    assert stats.bootstrap_ci(few, "v", "k", 50, statistic=stats.weighted_median).first()["estimate"] == 1.5
    assert stats.tost(few.withColumn("g", few["y"] > 0).withColumn("v", few["v"] * 0 + 3), "g", "v", 1.0).first()["p"] == 0.0


def test_jackknife_is_that_of_the_rows_left(spark):
    import numpy as np

    x = np.array([1.0, 4.0, 2.5, 9.0, 4.0])
    rows = spark.createDataFrame([(float(v),) for v in x], "v double")
    for kind, f in (("mean", np.mean), ("variance", lambda a: a.var(ddof=1))):
        left = np.array([f(np.delete(x, k)) for k in range(len(x))])
        r = stats.jackknife(rows, "v", estimator=kind).first()
        assert np.allclose([r["lo"], r["hi"], r["range"], r["std"]], [left.min(), left.max(), np.ptp(left), left.std(ddof=1)])


def test_overlap_join_tells_rows_with_nulls_apart(spark):
    from locusframe.operators.intervals import nearest_distance, overlap_join, spaced_topk

    a = spark.createDataFrame([(1, "c", 0, 5, None), (2, "c", 50, 60, None), (3, None, 0, 5, "x")], "id int, chrom string, start_pos int, end_pos int, note string")
    b = spark.createDataFrame([("c", 3, 9), ("c", 4, 6)], "chrom string, start_pos int, end_pos int")
    assert sorted(r["id"] for r in overlap_join(a, b, "left").collect()) == [1, 1, 2, 3]
    assert [r["id"] for r in overlap_join(a, b, "left_semi").collect()] == [1]
    assert sorted(r["id"] for r in overlap_join(a, b, "left_anti").collect()) == [2, 3]
    points = spark.createDataFrame([("c", 7), ("c", 30)], "chrom string, pos int")
    got = nearest_distance(a.withColumnRenamed("start_pos", "pos"), points).select("id", "distance").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 7), (2, 20), (3, None)]
    rng_rows = [("k", "c", (n * 7919) % 4000, (n * 7919) % 4000 + 5, float((n * 31) % 97)) for n in range(300)]
    df = spark.createDataFrame(rng_rows, "key string, chrom string, start_pos int, end_pos int, signal double")
    best, kept = {}, []
    for _, c, s, e, v in rng_rows:
        best[c, s, e] = max(v, best.get((c, s, e), v))
    for (c, s, e), v in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if len(kept) < 7 and all(abs(s - o[1]) >= 150 for o in kept):
            kept.append((c, s, e, v))
    assert sorted(tuple(r)[1:] for r in spaced_topk(df, "key", 150, 7).collect()) == sorted(kept)


def test_nearest_sequences_break_ties_by_key(spark):
    from locusframe.operators.seq import kmer_spectrum, nn_identity

    ref = spark.createDataFrame([(k, "ACGTAC" if k % 3 else "ACGTAA") for k in range(20)] + [(99, None), (98, "")], "id long, s string")
    ask = spark.createDataFrame([(100, "ACGTAC"), (101, None), (102, "ACG"), (5, "ACGTAC")], "id long, s string")
    for parts in (1, 3, 7):
        got = sorted(tuple(r) for r in nn_identity(ask, ref.repartition(parts), "s", "id", loo=True).collect())
        assert got == [(5, 1, 1.0, True), (100, 1, 1.0, True), (102, 0, 1.0, True)]
    assert nn_identity(ask.limit(0), ref, "s", "id").count() == 0
    odd = spark.createDataFrame([("ACNACG",), (None,), ("a",), ("acg",)], "s string")
    assert {r["kmer"]: r["n"] for r in kmer_spectrum(odd, "s", "s", 2).collect()} == {"AC": 3, "CG": 2}


def test_fasta_within_contigs(spark, tmp_path):
    from locusframe.sources.readers import read_fasta

    seqs = {f"c{k}": "".join("ACGT"[(n * n + k * n) % 4] for n in range(3000 + 700 * k)) for k in range(3)}
    (tmp_path / "x.fa").write_text("".join(f">{c} d\n" + "".join(s[n : n + 61] + "\n" for n in range(0, len(s), 61)) for c, s in seqs.items()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {(r["chrom"], r["chunk_start"]): r["seq"] for r in read_fasta(spark, str(tmp_path / "x.fa"), 256, 22).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(c, n): s[n : n + 278] for c, s in seqs.items() for n in range(0, len(s), 256)}
