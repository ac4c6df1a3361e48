"""Steps that grew faster than their input: results against plain versions, and plans without what made them grow."""

import random

from pyspark.sql import functions as F

from locusframe.operators import chromatin, intervals, matrix, offtarget, rank, scan, seq, stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_guides_meet_sites_without_a_shuffle(spark):
    texts = [(n, "".join("ACGTN"[(n * 31 + i * i * 7 + i // 3) % (5 if n == 3 else 4)] for i in range(400))) for n in range(6)] + [(9, None), (10, "ACG")]
    places = offtarget.sites(spark.createDataFrame(texts, "id long, seq string"), "seq", "id")
    guides = spark.createDataFrame([(t[40 + i : 60 + i].lower(),) for _, t in texts[:4] for i in (0, 9)] + [(None,), ("ACGTACGT",)], "guide string")
    got = offtarget.offtargets_seeded(places, guides, 8)
    assert "SortMergeJoin" not in plan(got) and "Exchange" not in plan(got)
    wanted = {g[0][:20].upper() for g in guides.collect() if g[0]}
    rows = places.collect()
    expected = sorted((r.id, r.pos, r.strand, g, d) for r in rows for g in wanted if len(g) == 20 for d in [sum(a != b for a, b in zip(g, r.site))] if d <= 8)
    assert expected and sorted((r.id, r.pos, r.strand, r.guide, r.mismatches) for r in got.collect()) == expected
    turn = str.maketrans("ACGTN", "TGCAN")
    plain = sorted((n, i, s, w[:20], w[20:]) for n, t in texts if t for i in range(len(t) - 22) for s, w in (("+", t[i : i + 23]), ("-", t[i : i + 23].translate(turn)[::-1])) if w[21:] == "GG")
    assert sorted((r.id, r.pos, r.strand, r.site, r.pam) for r in rows) == plain


def test_sums_over_overlaps_make_no_pairs(spark, monkeypatch):
    places = [(n, f"c{n % 2}", 10 * n % 97, 10 * n % 97 + n % 30) for n in range(60)] + [(90, None, 1, 9), (91, "c0", None, 9), (92, "c9", 1, 5), (5, "c1", 3, 80), (None, "c1", 3, 80)]
    records = [(f"c{n % 2}", 7 * n % 101, 7 * n % 101 + n % 12, None if n % 17 == 0 else float("nan") if n % 19 == 0 else n * 1.25) for n in range(300)] + [(None, 1, 50, 2.0), ("c1", None, 50, 2.0)]
    a = spark.createDataFrame(places, "key long, chrom string, start_pos long, end_pos long")
    b = spark.createDataFrame(records, "chrom string, start_pos long, end_pos long, value double")
    full = a.where("start_pos < end_pos or start_pos is null")
    meets = lambda p, r: None not in (*p[1:], *r[:3]) and p[1] == r[0] and p[2] < r[2] and p[3] > r[1]
    mean, depth, hit = {}, {}, set()
    for k in {p[0] for p in places} - {None}:
        over = [(p, r) for p in places if p[0] == k for r in records if meets(p, r)]
        values = [r[3] for p, r in over if r[3] is not None and r[3] == r[3]]
        mean[k] = round(sum(values) / len(values), 9) if values else None
        depth[k] = sum(min(p[3], r[2]) - max(p[2], r[1]) for p, r in over)
        hit |= {k} if over else set()
    # Rows of no length still meet in bins.
    assert {r.key: r.mean and round(r.mean, 9) for r in intervals.window_mean(a, b, "key").collect() if r.key is not None} == mean
    assert {r.key for r in intervals.overlap_semi(a, b, "key").collect()} == hit
    monkeypatch.setattr(intervals, "overlap_join", None)
    assert {r.key: round(r.mean, 9) for r in intervals.window_mean(full, b, "key").where("mean is not null").collect()} == {k: m for k, m in mean.items() if m is not None and (k == 5 or k % 30)}
    got = {(r.key, r.start_pos): round(r.depth * (r.end_pos - r.start_pos)) for r in intervals.coverage(b, full.where("key != 5"), "key").where("start_pos is not null").collect()}
    assert got == {(p[0], p[2]): depth[p[0]] for p in places if p[0] not in (None, 5) and p[2] is not None and p[2] < p[3]}
    assert {r.key for r in intervals.overlap_flag(full, b, "hit", "key").where("hit").collect()} == {k for k in hit if k == 5 or k % 30}
    assert {r.key for r in intervals.overlap_anti(full, b, "key").collect()} == {r.key for r in full.collect()} - hit


def test_dependency_without_lines_in_scope(spark):
    df = spark.createDataFrame([("G1", "S1", -1.0), ("G1", "S2", 0.5)], "gene string, sample string, value double")
    none = spark.createDataFrame([], "sample string")
    assert [tuple(r) for r in matrix.dependency(df, none).collect()] == [("G1", None, None)]
    assert [tuple(r) for r in matrix.dependency(df, df.where("sample = 'S1'")).collect()] == [("G1", 1.0, 1.5)]
    assert [tuple(r) for r in matrix.dependency(df).collect()] == [("G1", 0.25, None)]


def test_products_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(rank, "ROWS_A_TASK", 5)
    one = spark.range(40).coalesce(1)
    got = rank.pairs(one, "id")
    assert got.rdd.getNumPartitions() == 8 and sorted((r.a, r.b, r.logic) for r in got.collect()) == [(a, b, x) for a in range(40) for b in range(a + 1, 40) for x in ("AND", "OR")]
    side = lambda n, name: spark.range(n).coalesce(1).selectExpr(f"id as {name}", "id % 3 as target")
    got = rank.design_space(side(40, "p"), side(9, "e"), side(2, "g"))
    assert got.rdd.getNumPartitions() == 8
    assert sorted((r.target, r.p, r.e, r.g) for r in got.collect()) == sorted((p % 3, p, e, g) for p in range(40) for e in range(9) for g in range(2) if p % 3 == e % 3 == g % 3)


def test_pieces_of_a_text_come_from_one_scan(spark):
    from locusframe.plans.catalog import QUERIES

    assert "sequence(" not in plan(QUERIES["q10_melting_temp"](spark, "/root/testdata/sf0.001"))


def test_lists_of_dominators_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(rank, "LISTS", 30, raising=False)
    monkeypatch.setattr(rank, "ENTRIES", 100, raising=False)
    value = lambda n, m: float(n * m % 11)
    rows = [(f"k{n}", value(n, 3), value(n, 7), value(n * n, 5)) for n in range(200)]
    rows += [("k7", 10.0, 0.0, 1.0), ("k7", 0.0, 9.0, 1.0), ("odd", None, 1.0, 1.0), ("odd", float("nan"), 1.0, 1.0), (None, 1.0, 1.0, 1.0), (None, 10.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double").repartition(3)
    got = rank.dominance(df, "id", ["a", "b", "c"])
    assert "FlatMapCoGroups" not in plan(got) and "Join" not in plan(got)
    full = [r for r in rows if r[0] and all(x is not None and x == x for x in r[1:])]
    above = lambda p, q: all(x >= y for x, y in zip(p[1:], q[1:])) and p[1:] != q[1:]
    lists = {k: sorted({p[0] for q in full if q[0] == k for p in full if above(p, q)}) for k in {r[0] for r in rows}}
    assert sorted(((r.id or "", r.dominated_by) for r in got.collect())) == sorted((r[0] or "", lists[r[0]]) for r in rows)


def test_running_totals_are_summed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(intervals, "STRETCH", 16, raising=False)
    monkeypatch.setattr(scan, "sliced", None)  # nothing is put in one order as a whole
    reads = [(f"c{n % 2}", 7 * n % 301 - 40, 7 * n % 301 - 40 + n % 25, n * 1.25, n % 3) for n in range(300)]
    b = spark.createDataFrame(reads, "chrom string, start_pos long, end_pos long, value double, turn int")
    places = [(n, f"c{n % 3}", 13 * n % 400 - 60, 13 * n % 400 - 60 + 1 + n % 70) for n in range(80)]
    a = spark.createDataFrame(places, "key long, chrom string, start_pos long, end_pos long")
    over = lambda p, turns: [r[3] for r in reads if r[0] == p[1] and r[1] < p[3] and r[2] > p[2] and r[4] in turns]
    bare = lambda vs: sum(vs) / len(vs) if vs else None
    mean = lambda vs: short(bare(vs))
    short = lambda v: None if v is None else round(v, 8)
    calls, plain = [], intervals.looked_up if hasattr(intervals, "looked_up") else None
    monkeypatch.setattr(intervals, "looked_up", lambda *x: calls.append(1) or plain(*x), raising=False)
    got = chromatin.log2_residual(a, b.where("turn = 0"), b.where("turn > 0"), "key", replicate="turn").collect()
    assert len(calls) == 1  # case and control in one pass
    second = lambda p: [m for m in (bare(over(p, [1])), bare(over(p, [2]))) if m is not None]
    assert sorted((r.key, short(r.case), short(r.control)) for r in got) == sorted((p[0], mean(over(p, [0])), mean(second(p))) for p in places)
    loci = a.select("key", "chrom", "start_pos")
    full = b.where("start_pos < end_pos").withColumn("track", b.turn.cast("string"))
    swept = {(r.key, r.width, r.track): (short(r["mean"]), r.n) for r in chromatin.signal_means(loci, full, (5, 40), "key", "start_pos").collect()}
    assert swept == {(p[0], w, str(t)): (mean(vs), len(vs)) for p in places for w in (5, 40) for t in range(3) for vs in [[r[3] for r in reads if r[1] < r[2] and r[0] == p[1] and r[1] < p[2] + w and r[2] > p[2] - w and r[4] == t]]}


def test_replicates_draw_once_and_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(stats, "ROWS_A_TASK", 10, raising=False)
    df = spark.createDataFrame([(f"g{n}", n % 7 / 7, float(n * n % 31)) for n in range(60)], "gene string, beta double, score double").coalesce(1)
    names, seen = [], stats.written if hasattr(stats, "written") else None
    monkeypatch.setattr(stats, "written", lambda rows, name: names.append(name) or seen(rows, name), raising=False)
    out = stats.threshold_sweep_ci(df, "beta", "score", [0.3], "gene", 5, 6).collect()
    assert names == ["cells"] and out[0].lo <= out[0].hi
    assert plan(df.select(stats.poisson_weight(1, df.gene).alias("w"))).count("sha2(") == 1


def test_hashes_of_a_key_serve_its_parts(spark, monkeypatch):
    import hashlib

    rows = [(n, p) for n in range(90) for p in ("a", "b", "c") if (n + len(p)) % 5 or p == "b"]
    df = spark.createDataFrame(rows, "id long, part string")
    want = spark.createDataFrame([("a", 4), ("b", 30), ("c", 500)], "part string, k long")
    digest = lambda r, n: hashlib.sha256(f"3:{r}:{n}".encode()).hexdigest()
    expected = sorted((p, r, n) for p, k in (("a", 4), ("b", 30), ("c", 500)) for r in range(3) for n in sorted((n for n, q in rows if q == p), key=lambda n: digest(r, n))[:k])
    for few in (1000, 0):
        monkeypatch.setattr(stats, "FEW", few, raising=False)
        got = stats.smallest_hashes(df, "id", want, 3, 3, bin_rows=20, part=["part"])
        assert sorted((r.part, r["__r"], r.id) for r in got.collect()) == expected
        assert "inline(" in plan(got)


def test_fronts_follow_chains(spark, monkeypatch):
    rows = [(n, (n * 7919 % 1009) / 1009, n * 37 % 11 / 10, n * 53 % 11 / 10, n * 71 % 11 / 10) for n in range(400)]
    rows += [(900 + n, *rows[n][1:]) for n in range(5)] + [(990, None, 0.5, 0.5, 0.5), (991, float("nan"), 0.5, 0.5, 0.5), (992, 0.0, 0.0, 0.0, 0.0), (993, -0.0, 0.0, 0.0, 0.0)]
    whole = {r[0]: r[1:] for r in rows if r[0] not in (990, 991)}
    above = {k: [q for q in whole if q != k and whole[q] != p and all(x >= y for x, y in zip(whole[q], p))] for k, p in whole.items()}
    want = {990: 0, 991: 0}
    for k in sorted(whole, key=lambda k: len(above[k])):
        want[k] = 1 + max((want[q] for q in above[k]), default=-1)
    df = spark.createDataFrame(rows, ["id", *rank.OBJECTIVES])
    monkeypatch.setattr(rank, "_settled", None)  # no point is compared with points
    monkeypatch.setattr(rank, "_beaten", None)
    assert dict(rank.pareto_fronts(df, "id").select("id", "rank").collect()) == want
    monkeypatch.setattr(scan, "ALONE", 10)
    monkeypatch.setattr(rank, "SLICE", 150)
    assert dict(rank.pareto_fronts(df, "id").select("id", "rank").collect()) == want
    few = rank.pareto_fronts(df, "id", floor=F.col("safety") >= 0.5, max_rank=3).select("id", "rank").collect()
    good = {k: x for k, x in want.items() if k in whole and whole[k][3] >= 0.5}
    assert {k: x for k, x in few if k in good} == {k: x if x < 3 else None for k, x in good.items()}  # who dominates a feasible row here is feasible
    one = spark.createDataFrame([(n, n * 7 % 50 / 10) for n in range(500)], "id long, a double")
    assert dict(rank.pareto_fronts(one, "id", ["a"]).select("id", "rank").collect()) == {n: 49 - n * 7 % 50 for n in range(500)}
    parts = rank._ranks(df.where("id < 400").withColumn("p", F.col("id") % 2), list(rank.OBJECTIVES), ["p"]).collect()
    for p in (0, 1):
        mine = {k: v for k, v in whole.items() if k < 400 and k % 2 == p}
        deep: dict = {}
        for k in sorted(mine, key=lambda k: len([q for q in above[k] if q in mine])):
            deep[mine[k]] = 1 + max((deep[mine[q]] for q in above[k] if q in mine), default=-1)
        assert {tuple(r[1:5]): r["rank"] for r in parts if r["p"] == p} == deep


def test_overlap_pairs_come_from_ranges(spark, monkeypatch):
    draw = random.Random(8)
    place = lambda n, k: (n, draw.choice(["c1", "c2"]), (s := draw.randrange(-40, 400)), s + draw.choice([0, -3, 1, 5, 30, 120 if k else 7]))
    left = [place(n, 1) for n in range(90)] + [(7, "c1", 3, 80), (None, "c1", 3, 80), (500, None, 1, 9), (501, "c1", None, 9), (502, "c1", 1, None)]
    right = [place(n, 0) for n in range(200)] + [(3, "c1", 5, 300), (3, "c1", 5, 300), (500, None, 1, 9), (501, "c1", None, 9)]
    a = spark.createDataFrame(left, "a long, chrom string, start_pos long, end_pos int")
    b = spark.createDataFrame([(f"p{r[0]}", *r[1:]) for r in right], "b string, chrom string, start_pos long, end_pos long")
    want = sorted((str(p[0]), f"p{r[0]}") for p in left for r in right if None not in (*p[1:], *r[1:]) and p[1] == r[1] and p[2] < r[3] and p[3] > r[2])
    for size, crowd, pairs in ((8192, 20_000, 1_000_000), (32, 20_000, 50), (64, 4, 3)):
        monkeypatch.setattr(intervals, "CROWDED", crowd)
        monkeypatch.setattr(intervals, "PAIRS", pairs)
        got = intervals.overlap_pairs(a, b, "a", "b", size)
        assert "Join" not in plan(got).replace("BroadcastHashJoin", "")  # no row meets another in a join
        assert sorted((str(r.a), r.b) for r in got.collect()) == want
    assert intervals.overlap_pairs(a.where("false"), b, "a", "b").count() == 0
    assert intervals.overlap_pairs(a, b.where("false"), "a", "b").count() == 0


def test_sites_of_both_strands_come_from_one_scan(spark, monkeypatch):
    draw = random.Random(4)
    texts = [(n, "".join(draw.choice("ACGGCTgcN" if n % 3 == 0 else "ACGGCT") for _ in range(30 + 9 * n))) for n in range(12)]
    texts += [(20, None), (21, ""), (22, "GG" * 15), (23, "GG" * 16), (24, "CC" * 15 + "A"), (25, "ACGé" + "GGCC" * 12), (26, "ß" + "CCGG" * 12)]
    turn = str.maketrans("ACGTN", "TGCAN")
    want = []
    for n, s in texts:
        up = (s or "").upper()
        for strand, t in (("+", up), ("-", up[::-1].translate(turn))):
            for i in range(4, len(t) - 26):
                if t[i + 21 : i + 23] == "GG" and "N" not in t[i : i + 20]:
                    want.append((n, strand, 100 + (i if strand == "+" else len(t) - i - 20), t[i : i + 20], t[i + 20 : i + 23], t[i - 4 : i + 26]))
    df = spark.createDataFrame([(*t, 100) for t in texts], "id long, seq string, off int")
    for letters in (4 << 20, 50):
        monkeypatch.setattr(seq, "STRETCH", letters)
        found = seq.enumerate_sites(df.coalesce(1), "seq", "id", "off")
        assert "translate" not in plan(found) and "Generate" not in plan(found)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_vectors_are_summed_up_in_their_task(spark, monkeypatch):
    draw = random.Random(6)
    contexts = ["".join(draw.choice("ACGT" if n % 4 else "ACGTNé") for _ in range(30)) for n in range(40)] + [None, "G" * 30, "acgt" * 7 + "aa", "ACGTACGTA", ""]
    df = spark.createDataFrame(list(enumerate(contexts)), "id long, c string")
    monkeypatch.setattr(seq, "VECTORS", 7)
    for column, vectors in ((seq.guide_features, seq.plain_vectors), (seq.guide_features_ext, seq.extended_vectors)):
        found = seq.vector_digest(df, "c", vectors)
        assert found.columns == ["id", "ones", "place", "last"] and "transform" not in plan(found)
        got = {r[0]: tuple(r[1:]) for r in found.collect()}
        assert got.pop(40) == (None, None, None)
        for n, x in df.where("c is not null").select("id", column("c").alias("x")).collect():
            ones, place, last = got[n]
            assert (ones, last) == (sum(e == 1 for e in x), x[-1]) and abs(place - sum(e * k for k, e in enumerate(x, 1))) < 1e-9


def test_maxima_over_overlaps_are_gathered_nowhere(spark, monkeypatch):
    monkeypatch.setattr(intervals, "REACH", 16, raising=False)
    draw = random.Random(11)
    place = lambda long: (draw.choice(["c1", "c2"]), (s := draw.randrange(-60, 500)), s + draw.choice([1, 5, 15, 16, 17, 40, 300 if long else 2]))
    odd = [("c1", 20, 20), ("c1", 30, 25), (None, 1, 9), ("c1", None, 9), ("c2", 1, None), ("c9", 1, 9)]
    left = [(n, *place(n % 5 == 0)) for n in range(80)] + [(7, "c1", 3, 80), (7, "c2", 3, 80), (None, "c1", 3, 80)] + [(200 + n, *p) for n, p in enumerate(odd)]
    values = [None, float("-inf"), float("inf"), float("nan"), -0.5, -3.0]
    right = [(*place(n % 9 == 0), values[n] if n < 6 else draw.uniform(-9, 9), "xyz"[n % 3], n % 2) for n in range(120)] + [(*p, 99.0, "x", 0) for p in odd]
    for some in (right, right[:2], right[6:60], right[60:61]):
        a = spark.createDataFrame(left, "key long, chrom string, start_pos int, end_pos long")
        b = spark.createDataFrame(some, "chrom string, start_pos long, end_pos long, value double, mark string, side int")
        over = lambda k: [r for p in left if p[0] == k is not None for r in some if None not in (*p[1:], *r[:3]) and p[1] == r[0] and p[2] < r[2] and p[3] > r[1]]
        order = lambda v: (v != v, v)
        best = {p[0]: (str(max((r[3] for r in over(p[0]) if r[3] is not None), key=order, default=0.0)), bool(over(p[0]))) for p in left}
        got = intervals.overlap_max(a, b, "value", "key", flag="hit")
        assert {r.key: (str(r.best), r.hit) for r in got.collect()} == best
        assert "BroadcastHashJoin" not in plan(got) and "BroadcastExchange" not in plan(got)
        calls = {k: tuple(any((r[4], r[5]) == (m, s) for r in over(k)) for m in "xy" for s in (0, 1)) for k in {p[0] for p in left}}
        made = intervals.mark_calls(a, b.where("side = 0"), b.where("side = 1"), ["x", "y"], "key")
        assert {r.key: (r.x_case, r.x_control, r.y_case, r.y_control) for r in made.collect()} == calls
        assert all(r.x_gain == (r.x_case and not r.x_control) for r in made.collect()) and made.count() == len(calls)


def test_products_come_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(rank, "ROWS_A_TASK", 6)
    monkeypatch.setattr(rank, "TILE", 4, raising=False)
    p = spark.createDataFrame([(n % 3 if n % 11 else None, f"p{n}", n * 0.5) for n in range(50)], "t int, p string, x double")
    e = spark.createDataFrame([(n * 7 % 4, n) for n in range(30)] + [(None, 99), (1, None), (1, 5), (1, 5)], "t int, e long")
    g = spark.createDataFrame([(0, "g"), (1, "g"), (1, "h"), (2, None), (None, "i")], "t int, g string")
    got = rank.design_space(p, e, g, "t")
    assert got.columns == ["t", "p", "x", "e", "g"]
    parts = got.rdd.glom().collect()
    rows = [tuple(r) for part in parts for r in part]
    ps, es, gs = p.collect(), e.collect(), g.collect()
    want = [(*a, b[1], c[1]) for a in ps for b in es for c in gs if a[0] is not None and a[0] == b[0] == c[0]]
    assert want and sorted(map(repr, rows)) == sorted(map(repr, want))
    assert all(len({r[:1] for r in part}) <= 3 and len({r[1] for r in part}) <= 6 for part in parts)
    # An other side's key comes back within a tile, not once all others have come.
    steps = [y - x for part in ([r for r in part if r.t == 0] for part in parts) for n in {r.e for r in part} for at in [[i for i, r in enumerate(part) if r.e == n]] for x, y in zip(at, at[1:])]
    assert steps and sorted(steps)[len(steps) // 2] <= 4
    keys = spark.createDataFrame([(f"k{n % 23}",) for n in range(25)] + [(None,)], "k string")
    names = [r.k for r in keys.collect()]
    assert sorted(tuple(r) for r in rank.pairs(keys, "k").collect()) == sorted((a, b, x) for a in names for b in names if None not in (a, b) and a < b for x in ("AND", "OR"))
    assert rank.pairs(keys.where("k is null"), "k").count() == 0 and rank.design_space(p.where("false"), e, g, "t").count() == 0


def test_points_of_dominance_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(rank, "LISTS", 10)
    rows = [(n % 60, float(n * 3 % 7), float(n * 5 % 11)) for n in range(70)]
    got = rank.dominance(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"])
    assert "Generate" not in plan(got) and "CartesianProduct" in plan(got)  # tasks read one copy
    lists = {k: sorted({p[0] for q in rows if q[0] == k for p in rows if p[1] >= q[1] and p[2] >= q[2] and p[1:] != q[1:]}) for k, _, _ in rows}
    assert sorted((r.id, r.dominated_by) for r in got.collect()) == sorted((r[0], lists[r[0]]) for r in rows)
    none = spark.createDataFrame([(1, None, 1.0), (2, 1.0, float("nan"))], "id long, a double, b double")  # no points, two rows
    assert sorted(map(tuple, rank.dominance(none, "id", ["a", "b"]).collect())) == [(1, []), (2, [])]
    assert rank.dominance(none.where("false"), "id", ["a", "b"]).count() == 0
