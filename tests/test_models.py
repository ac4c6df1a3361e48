"""Model statistics, seed stability and the feature table against plain numpy versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import evaluate, matrix, models


def plain_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def plain_logistic(x, y, ridge=0.01):
    """Coefficients of a ridge logistic fit on standardised columns, by Newton's method; the intercept is free."""
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(x) + np.diag(penalty), z.T @ (p - y) / len(x) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return lambda q: np.column_stack([(q - mean) / sd, np.ones(len(q))]) @ w


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=240) > 0).astype(int)
    rows = [(f"k{i:03d}", float(y[i]), *map(float, x[i])) for i in range(240)]
    return rows, spark.createDataFrame(rows, "key string, y double, a double, b double, c double").cache()


def fold_of(label, key, folds, seed, rows):
    digest = hashlib.sha256(f"{seed}:{label}:{key}".encode()).hexdigest()
    return int(digest[:12], 16) % folds


def test_cross_validated_auc(table):
    rows, df = table
    dealt = {r["key"]: r["fold"] for r in models.with_folds(df, "y", "key", 3, 1).collect()}
    assert set(dealt.values()) == {0, 1, 2} and min(list(dealt.values()).count(k) for k in range(3)) > 50
    got = models.cv_auc(df, ["a", "b", "c"], "y", "key", seeds=(1,)).first()
    x, y, fold = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows]), np.array([dealt[r[0]] for r in rows])
    score = np.zeros(len(rows))
    for k in range(3):
        score[fold == k] = plain_logistic(x[fold != k], y[fold != k])(x[fold == k])
    assert abs(got["auroc"] - plain_auc(y, score)) < 2e-3 and (got["n_pos"], got["n_neg"]) == (y.sum(), (1 - y).sum())
    only = {r["feature"]: r["auroc"] for r in models.cv_univariate(df, ["a", "c"], "y", "key", folds=2).collect()}
    gone = {r["without"]: r["auroc"] for r in models.cv_ablation(df, ["a", "b"], "y", "key", folds=2).collect()}
    fold = np.array([r["fold"] for r in models.with_folds(df, "y", "key", 2, 0).orderBy("key").collect()])
    for columns, value in (([0], only["a"]), ([2], only["c"]), ([0, 1], gone[None]), ([1], gone["a"]), ([0], gone["b"])):
        for k in range(2):
            score[fold == k] = plain_logistic(x[fold != k][:, columns], y[fold != k])(x[fold == k][:, columns])
        assert abs(value - plain_auc(y, score)) < 5e-3
    null = models.cv_null(df, ["a"], "y", "key", 4, folds=2).first()
    assert null["ge"] == 0 and null["p"] == 0.2


def test_permutation_importance(table):
    rows, df = table
    model = models._pipeline(["a", "b", "c"], "y", "logistic", 0).fit(df)
    got = {r["feature"]: r["drop"] for r in models.permutation_importance(model, df, ["a", "b", "c"], "y", "key").collect()}
    x, y = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    score = plain_logistic(x, y)
    salt = [r["s"] for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(16)).alias("s")).orderBy("key").collect()]
    mixed = np.arange(len(rows))
    for s in set(salt):
        mine = [k for k in range(len(rows)) if salt[k] == s]
        dealt = sorted(mine, key=lambda k: hashlib.sha256(f"0:{rows[k][0]}".encode()).hexdigest())
        mixed[mine] = dealt
    for j, f in enumerate("abc"):
        z = x.copy()
        z[:, j] = x[mixed, j]
        assert abs(got[f] - (plain_auc(y, score(x)) - plain_auc(y, score(z)))) < 2e-3
    assert got["a"] > got["c"]


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_regressors_learn_a_step(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.random((400, 2))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + np.where(x[:, 1] > 0.25, 0.5, 0.0)
    df = spark.createDataFrame([(k, float(a), float(b), float(v)) for k, ((a, b), v) in enumerate(zip(x, y))], "k long, a double, b double, y double")
    model = models.fit_regressor(df.where("k < 300"), ["a", "b"], "y", kind)
    rows = model.transform(df.where("k >= 300")).collect()
    error = np.mean([(r["prediction"] - r["y"]) ** 2 for r in rows])
    assert error < 0.25 * np.var(y[300:])


def test_seed_stability(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(50, 4))
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    seeds = {0: base, 1: base @ turn, 2: rng.normal(size=(50, 4)) * [5, 1, 1, 1]}
    df = spark.createDataFrame([(s, k, [float(v) for v in row]) for s, m in seeds.items() for k, row in enumerate(m)], "seed long, example long, factors array<double>")
    got = {(r["a"], r["b"]): r for r in evaluate.stability_audit(df, "seed", "example", "factors").collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for (a, b), r in got.items():
        x, y = (seeds[s] - seeds[s].mean(axis=0) for s in (a, b))
        kx, ky, cross = x.T @ x, y.T @ y, x.T @ y
        cka = (cross**2).sum() / math.sqrt((kx**2).sum() * (ky**2).sum())
        nuclear = np.linalg.svd(cross, compute_uv=False).sum()
        values = np.linalg.eigvalsh(kx)
        share = values / values.sum()
        want = (cka, math.sqrt(max(0, 1 - nuclear**2 / (np.trace(kx) * np.trace(ky)))), math.exp(-(share * np.log(share)).sum()), share.max())
        assert np.allclose([r[c] for c in ("cka", "nrmse", "effective_rank", "top_share")], want, atol=1e-6) and r["ok"] == (cka >= 0.5)
    assert got[0, 1]["ok"] and got[0, 1]["nrmse"] < 1e-3


def test_feature_matrix(spark):
    rng = np.random.default_rng(2)
    genes, samples = [f"g{k}" for k in range(12)], [f"s{k}" for k in range(9)]
    tumour = {(g, s): float(rng.random() * 9) for g in genes for s in samples}
    normal = {(g, f"n{k}"): float(rng.random() * 9) for g in genes[:10] for k in range(3)}
    frame = lambda d: spark.createDataFrame([(g, s, v) for (g, s), v in d.items()], "gene string, sample string, value double")
    signatures = spark.createDataFrame([("basal", "g0"), ("basal", "g1"), ("classical", "g2"), ("classical", "g3")], "signature string, gene string")
    mutations = spark.createDataFrame([("g0", "s1", "Missense_Mutation"), ("g0", "s2", "Silent"), ("g4", "s1", "Nonsense_Mutation"), ("zz", "s1", "Silent")], "gene string, sample string, variant_class string")
    lines = spark.createDataFrame([("s0",), ("s1",)], "sample string")
    few = lambda *g: spark.createDataFrame([(x,) for x in g], "gene string")
    out = {r["gene"]: r for r in matrix.feature_matrix(frame(tumour), frame(normal), signatures, mutations, 9, frame(tumour), lines, few("g0", "g5"), few("g6")).collect()}
    assert sorted(out) == sorted(genes)
    log = lambda g: np.array([math.log2(tumour[g, s] + 1) for s in samples])
    score = {n: np.mean([log(g) for g in pair], axis=0) for n, pair in (("basal", ("g0", "g1")), ("classical", ("g2", "g3")))}
    for g in genes:
        r = out[g]
        assert abs(r["tumor_mean_log"] - log(g).mean()) < 1e-9
        for name, column in (("basal", "basal_r"), ("classical", "classical_r")):
            assert r[column] is not None and -1 - 1e-9 <= r[column] <= 1 + 1e-9
        assert r["driver"] == (g in ("g0", "g5")) and r["is_control"] == (g == "g6")
        assert abs(r["max_subtype_r"] - max(abs(r["basal_r"]), abs(r["classical_r"]))) < 1e-12
    assert abs(out["g7"]["basal_r"] - np.corrcoef(log("g7"), score["basal"])[0, 1]) < 0.25  # scores standardise genes
    freq = [r["mut_freq"] for r in out.values()]
    assert out["g0"]["mut_freq"] == max(freq) and out["g1"]["mut_freq"] in (0, None)
