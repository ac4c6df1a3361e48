"""Networks as edge tables (src, dst, weight). Iterations write their rounds to the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.iterate import written


#: Genes and samples of a block of the matrix.
GENES, SAMPLES = 256, 4096


def _packer():
    """One block of genes by samples as a dense matrix, NaN where a sample is missing."""

    def pack(rows: pa.Table) -> pa.Table:
        gene, i = np.unique(np.array(rows["gene"].to_pylist(), object), return_inverse=True)
        sample, j = np.unique(np.array(rows["sample"].to_pylist(), object), return_inverse=True)
        matrix = np.full((len(gene), len(sample)), np.nan)
        matrix[i, j] = rows["x"].to_numpy()
        return pa.table({"block": rows["block"][:1], "part": rows["part"][:1], "genes": pa.array([gene.tolist()]), "samples": pa.array([sample.tolist()]), "x": pa.array([matrix.tobytes()], pa.binary())})

    return pack


def _product(tau: float | None):
    """Sums over common samples of all pairs of genes of two blocks, by matrix products of values and of what is there."""

    def matrix(t: pa.Table, samples: np.ndarray) -> tuple[list, np.ndarray]:
        genes, mine = t["genes"][0].as_py(), np.array(t["samples"][0].as_py(), object)
        x = np.full((len(genes), len(samples)), np.nan)
        x[:, np.searchsorted(samples, mine)] = np.frombuffer(t["x"][0].as_py(), np.float64).reshape(len(genes), -1)
        return genes, x

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["src", "dst", "n", "x", "y", "xx", "yy", "xy"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.string() if c in ("src", "dst") else pa.float64()) for c in names})
        samples = np.union1d(np.array(left["samples"][0].as_py(), object), np.array(right["samples"][0].as_py(), object))
        (ga, a), (gb, b) = matrix(left, samples), matrix(right, samples)
        ma, mb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        sums = [ma @ mb.T, a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T, a @ b.T]
        keep = (sums[0] > 0) & (np.array(ga, object)[:, None] < np.array(gb, object)[None, :])
        if left["block"][0] != right["block"][0]:
            keep = sums[0] > 0
        if tau is not None:  # all samples are here
            n, x, y, xx, yy, xy = sums
            with np.errstate(all="ignore"):
                keep &= np.abs((n * xy - x * y) / np.sqrt((n * xx - x * x) * (n * yy - y * y))) > tau - 1e-6
        i, j = np.nonzero(keep)
        low = np.array([ga[k] for k in i], object), np.array([gb[k] for k in j], object)
        swap = low[0] > low[1] if len(i) else np.zeros(0, bool)
        vals = [s[keep] for s in sums]
        vals[1], vals[2] = np.where(swap, vals[2], vals[1]), np.where(swap, vals[1], vals[2])
        vals[3], vals[4] = np.where(swap, vals[4], vals[3]), np.where(swap, vals[3], vals[4])
        ends = np.where(swap, low[1], low[0]), np.where(swap, low[0], low[1])
        return pa.table({**{c: pa.array(e.tolist(), pa.string()) for c, e in zip(names, ends)}, **{c: pa.array(v, pa.float64()) for c, v in zip(names[2:], vals)}})

    return multiply


def coexpression_edges(df: DataFrame, tau: float, genes: int = GENES, samples: int = SAMPLES) -> DataFrame:
    """(src, dst, weight, sign), both directions: Pearson r of genes over their common samples, |r| > tau.

    A blocked matrix product: the table is cut into blocks of genes by samples, each pair of gene blocks meets once for
    every part of the samples, and products of values and of presence give the six sums of r. What is shuffled is each
    block once a block of genes, and sums of pairs that have common samples; with one part of samples only the pairs over
    ``tau``. Values are taken from their gene's mean first. Rows of one gene and sample are averaged; null or NaN values
    are missing; a gene that is constant over the common samples has no edge; null genes or samples are passed over.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("gene", "sample")}
    cells = df.where("gene is not null and sample is not null and value is not null and not isnan(value)").groupBy(F.col("gene").cast("string").alias("gene"), F.col("sample").cast("string").alias("sample")).agg(F.avg("value").alias("x"))
    cells = written(cells, "cells")
    n_genes, n_samples = cells.agg(F.countDistinct("gene"), F.countDistinct("sample")).first()
    blocks, parts = max(1, -(-n_genes // genes)), max(1, -(-n_samples // samples))
    means = cells.groupBy("gene").agg(F.avg("x").alias("__m"))
    at = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    placed = cells.join(means, "gene").select("gene", "sample", (F.col("x") - F.col("__m")).alias("x"), at("gene", blocks, "block"), at("sample", parts, "part"))
    packed = written(placed.groupBy("block", "part").applyInArrow(_packer(), "block int, part int, genes array<string>, samples array<string>, x binary"), "blocks")
    left = packed.withColumn("to", F.explode(F.expr(f"sequence(block, {blocks - 1})")))
    right = packed.select(F.col("block"), F.col("part").alias("q"), "genes", "samples", "x", F.explode(F.expr("sequence(0, block)")).alias("of"))
    left = left.select("block", "part", "to", "genes", "samples", "x")
    sums = left.groupBy("block", "to", "part").cogroup(right.groupBy("of", "block", "q")).applyInArrow(_product(tau if parts == 1 else None), "src string, dst string, n double, x double, y double, xx double, yy double, xy double")
    if parts > 1:
        sums = sums.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n, x, y = (F.col(c) for c in ("n", "x", "y"))
    spread = lambda ss, s: F.when(n * F.col(ss) - s * s > 1e-12 * n * F.col(ss), n * F.col(ss) - s * s)
    r = (n * F.col("xy") - x * y) / F.sqrt(spread("xx", x) * spread("yy", y))
    kept = sums.select("src", "dst", r.alias("r")).where(F.abs("r") > tau)
    kept = kept.select(F.col("src").cast(kinds["gene"]).alias("src"), F.col("dst").cast(kinds["gene"]).alias("dst"), F.abs("r").alias("weight"), F.signum("r").cast("int").alias("sign"))
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "sign"))


def degrees(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(node, out_degree, in_degree, out_strength, in_strength, over): over counts out-edges above the threshold."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"), F.sum("weight").alias("out_strength"), F.sum((F.col("weight") > threshold).cast("long")).alias("over"))
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"), F.sum("weight").alias("in_strength"))
    return out.join(inn, "node", "full").na.fill(0)


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, tol: float = 1e-9, rounds: int = 200, every: int = 5) -> DataFrame:
    """(node, rank): weighted out-shares, dangling mass spread evenly, until the largest change is under ``tol``.

    Null ends are a node; edges that come twice add up; a table without edges has no node.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("__t"))
    share = written(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("__t")).alias("share")), "shares")
    nodes = written(_nodes(edges).join(total.select(F.col("src").alias("node"), F.lit(True).alias("sends")), "node", "left"), "nodes")
    n = max(nodes.count(), 1)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for turn in range(1, rounds + 1):
        idle = ranks.where("sends is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("__idle"))
        got = share.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("__got"))
        new = ranks.join(got, "node", "left").crossJoin(F.broadcast(idle)).select("node", "sends", ((1 - damping) / n + damping * (F.coalesce("__got", F.lit(0.0)) + F.col("__idle") / n)).alias("rank"), F.col("rank").alias("__old"))
        if turn % every == 0 or turn == rounds:
            new = written(new, "ranks")
            if (new.agg(F.max(F.abs(F.col("rank") - F.col("__old")))).first()[0] or 0.0) < tol:
                ranks = new.drop("__old")
                break
        ranks = new.drop("__old")
    return ranks.select("node", "rank")


def _power(start: DataFrame, names: Sequence[str], rounds: int, tol: float, step) -> DataFrame:
    """Power iteration, each of ``names`` kept at length 1, until no entry changes by ``tol`` or after ``rounds``.

    Each round is written, so plans do not grow; its lengths, one number a name, are all that the driver sees. An
    iteration that would lose all length (a graph without a way on) ends with what it had.
    """
    state = start
    for _ in range(rounds):
        old = state.select("node", *[F.col(c).alias(f"__{c}") for c in names])
        new = written(step(state).join(old, "node"), "power")
        sizes = [r or 0.0 for r in new.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))) for c in names]).first()]
        if not any(sizes):
            break
        new = new.withColumns({c: F.col(c) / n if n else F.lit(0.0) for c, n in zip(names, sizes)})
        change = new.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"__{c}")) for c in names], F.lit(0.0)))).first()[0] or 0.0
        state = new.select("node", *names)
        if change < tol:
            break
    return state


def _sent(edges: DataFrame, state: DataFrame, value: str, back: bool = False, name: str = "got") -> DataFrame:
    a, b = ("dst", "src") if back else ("src", "dst")
    return edges.join(state.select(F.col("node").alias(a), F.col(value).alias("__v")), a).groupBy(F.col(b).alias("node")).agg(F.sum(F.col("weight") * F.col("__v")).alias(name))


def hits(edges: DataFrame, rounds: int = 200, tol: float = 1e-9) -> DataFrame:
    """(node, hub, authority), each of length 1; authorities from hubs, then hubs from the new authorities."""
    edges = written(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    nodes = _nodes(edges)

    def step(state: DataFrame) -> DataFrame:
        authority = _sent(edges, state, "hub", name="authority")
        hub = _sent(edges, authority, "authority", back=True, name="hub")
        return nodes.join(hub, "node", "left").join(authority, "node", "left").na.fill(0.0)

    return _power(nodes.withColumn("hub", F.lit(1.0)).withColumn("authority", F.lit(1.0)), ("hub", "authority"), rounds, tol, step)


def hub_proxy(edges: DataFrame) -> DataFrame:
    """(node, hub): one step, weights times the in-degree strength of the targets."""
    strength = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("s"))
    return _sent(edges, strength, "s", back=True, name="hub")


def eigencentrality(edges: DataFrame, rounds: int = 200, tol: float = 1e-12) -> DataFrame:
    """(node, centrality) of length 1: power iteration on the 0/1 adjacency of edges with a weight over 0.

    Edges that come twice count once; a null weight is no edge; without edges there is no node.
    """
    nodes = written(_nodes(edges), "nodes")
    plain = written(edges.where("weight > 0").select("src", "dst").distinct().withColumn("weight", F.lit(1.0)), "edges")
    step = lambda s: nodes.join(_sent(plain, s, "centrality", back=True, name="centrality"), "node", "left").na.fill(0.0)
    return _power(nodes.withColumn("centrality", F.lit(1.0)), ("centrality",), rounds, tol, step)


def centrality_composite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with centrality = mean of z-scores (population spread) and peripherality = its negative."""
    moments = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0)
    total = sum((z(c) for c in columns), F.lit(0.0)) / len(columns)
    out = df.crossJoin(F.broadcast(moments)).select(*df.columns, total.alias("centrality"))
    return out.withColumn("peripherality", -F.col("centrality"))


def motif_supported_edges(edges: DataFrame, motifs: DataFrame, up: Column | None = None) -> DataFrame:
    """``edges`` with ``support`` from a motif score table (src, dst, score)."""
    return edges.join(motifs.select("src", "dst", F.col("score").alias("support")), ["src", "dst"], "left").na.fill(0.0, ["support"])


def motif_targets_up(motifs: DataFrame, genes: DataFrame) -> DataFrame:
    """(src, n): motif targets whose gene (gene, log2fc) is up in disease."""
    up = genes.where("log2fc > 0").select(F.col("gene").alias("dst"))
    return motifs.where("score > 0").join(up, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("n"))
