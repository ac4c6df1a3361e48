"""Embedding near-dedup by the epsilon grid order join (Boehm et al., 2001).

Cosine >= c between unit vectors is a distance <= eps = sqrt(2 - 2c). Vectors are rotated to principal directions
(fitted on a bounded sample; any rotation gives the same result), sorted by the grid cells of side eps on the leading
ones, and cut into blocks. The join recurses over intervals of that sequence: pairs of intervals start whole, split by
``FAN`` a level, and drop out once their bounding boxes are provably more than eps apart. What is left are pairs of
blocks, compared in double precision by matrix products. Blocks travel once for each pair of bands (runs of blocks) that
they are needed in, so what is shuffled grows with bands and not with pairs of blocks.

Equal vectors are one row with a count, so a large group of copies costs nothing. A pair of blocks gives each vector's
number of links and a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import component_minimum, connected_components, hash_sample, table, written
from locusframe.llm.simhash import unite

COSINE = 0.9
BLOCK = 4096
#: Blocks of a band: at most so many, and so many bytes of doubles in the two bands of a task.
MAX_BAND, BAND_BYTES = 16, 256 << 20
FAN = 8
GRID_DIMS, BOX_DIMS = 8, 16
PCA_SAMPLE = 5000


def _valid(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _units(vectors: list[list[float]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # no overflow in the squares
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _leader(basis: Broadcast, eps: float):
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _units(batch["vec"].to_pylist(), len(basis.value)) @ basis.value[:, :BOX_DIMS]
            cells = np.floor(turned[:, :GRID_DIMS] / eps).astype(np.int32)
            out = batch.append_column("lead", pa.array(list(turned), pa.list_(pa.float64())))
            yield out.append_column("cells", pa.array(list(cells), pa.list_(pa.int32())))

    return lead


def _block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("node")
    lead = np.array(rows["lead"].to_pylist())
    sizes = np.array([len(v) for v in rows["vec"].to_pylist()], np.int32)
    return pa.table({
        "part": rows["part"][:1], "nth": rows["nth"][:1],
        "nodes": pa.array([rows["node"].to_numpy().tobytes()], pa.binary()), "copies": pa.array([rows["copies"].to_numpy().tobytes()], pa.binary()),
        "sizes": pa.array([sizes.tobytes()], pa.binary()), "data": pa.array([rows["vec"].combine_chunks().flatten().to_numpy().tobytes()], pa.binary()),
        "low": pa.array([lead.min(axis=0).tolist()]), "high": pa.array([lead.max(axis=0).tolist()]),
    })


def _gap(a: str, b: str) -> Column:
    """Square of the distance between two boxes."""
    one = F.zip_with(f"{a}_low", f"{b}_high", lambda x, y: x - y)
    two = F.zip_with(f"{b}_low", f"{a}_high", lambda x, y: x - y)
    return F.aggregate(F.zip_with(one, two, lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)


def _boxes(blocks: DataFrame, width: int, name: str) -> DataFrame:
    """The bounding box of each interval of ``width`` blocks."""
    at = (F.col("rank") / width).cast("long").alias(name)
    n = BOX_DIMS
    rows = blocks.groupBy(at).agg(*[F.min(F.get("low", F.lit(i))).alias(f"l{i}") for i in range(n)], *[F.max(F.get("high", F.lit(i))).alias(f"h{i}") for i in range(n)])
    pick = lambda c: F.filter(F.array(*[f"{c}{i}" for i in range(n)]), lambda x: x.isNotNull())
    return rows.select(name, pick("l").alias(f"{name}_low"), pick("h").alias(f"{name}_high"))


def near_intervals(blocks: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """(a, b), a <= b: ranks of blocks that may hold a link, by recursion over intervals of the sequence."""
    spark, width = blocks.sparkSession, 1
    while width < n_blocks:
        width *= FAN
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    child = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.col(c) * FAN + i)).alias(c)
    while width > 1:
        width //= FAN
        pairs = pairs.select(child("a"), "b").select("a", child("b")).where("a <= b")
        pairs = pairs.join(_boxes(blocks, width, "a"), "a").join(_boxes(blocks, width, "b"), "b")
        pairs = pairs.where(_gap("a", "b") <= eps * eps + 1e-9).select("a", "b")
    return pairs


def _vectors(row: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], np.int32)
    parts = np.split(np.frombuffer(row["data"], kind), np.cumsum(sizes)[:-1])
    return np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64), sizes, _units(parts, int(sizes.max()))


def _joiner(cosine: float, kind: str):
    def join_pair(one: tuple, two: tuple, own: bool) -> pa.Table:
        (node_a, copies_a, size_a, a), (node_b, copies_b, size_b, b) = one, two
        dims = min(a.shape[1], b.shape[1])
        links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        parent = np.arange(len(a) + len(b))
        for k in range(0, len(a), 512):
            near = (a[k : k + 512, :dims] @ b[:, :dims].T >= cosine) & (size_a[k : k + 512, None] == size_b[None, :])
            if own:
                near[np.arange(len(near)), np.arange(k, k + len(near))] = False
            i, j = np.nonzero(near)
            links_a[k : k + 512] = np.bincount(i, copies_b[j], len(near)).astype(np.int64)
            links_b += np.bincount(j, copies_a[k + i], len(b)).astype(np.int64)
            unite(parent, i + k, j if own else j + len(a))
        nodes = np.concatenate([node_a, node_b])
        n = len(a) if own else len(nodes)
        links = links_a if own else np.concatenate([links_a, links_b])
        some = np.flatnonzero(links[:n])
        return pa.table({"node": nodes[:n][some], "links": links[:n][some], "root": nodes[parent[:n][some]]})

    def join(rows: pa.Table) -> pa.Table:
        blocks = {r["rank"]: _vectors(r, kind) for r in rows.drop_columns(["pairs"]).to_pylist()}
        return pa.concat_tables([join_pair(blocks[p["a"]], blocks[p["b"]], p["a"] == p["b"]) for p in rows["pairs"][0].as_py()])

    return join


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or have a null or non-finite component link with nothing, and vectors of
    different length not with each other. Rows may repeat; equal vectors link. A null id is passed over as smallest id.
    An empty table gives no rows; other columns are ignored.
    """
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    vec = F.col(vec_col) if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(_valid(vec), vec).alias("vec"))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = written(classes, "vectors")
    dims = classes.agg(F.max(F.size("vec"))).first()[0]
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = _units([r[0] for r in hash_sample(classes.select("vec"), PCA_SAMPLE, "vec").collect()], dims)
    basis = spark.sparkContext.broadcast(np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dims, dims))[1][:, ::-1] if len(sample) > 1 else np.eye(dims))
    kind = classes.schema["vec"].dataType.simpleString()
    led = classes.mapInArrow(_leader(basis, eps), f"vec {kind}, first long, copies long, lead array<double>, cells array<int>")
    order = ["cells", "lead"]
    sequence = led.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())
    sequence = written(sequence, "grid-order")
    part, nth = F.shiftright("node", 33).alias("part"), (F.col("node").bitwiseAND((1 << 33) - 1) / BLOCK).cast("long").alias("nth")
    blocks = sequence.select(part, nth, "node", "copies", "vec", "lead").groupBy("part", "nth").applyInArrow(
        _block, "part long, nth long, nodes binary, copies binary, sizes binary, data binary, low array<double>, high array<double>")
    blocks = written(blocks, "grid-blocks")
    counts = blocks.groupBy("part").count().orderBy("part").collect()  # a row per partition of the sequence
    begins = np.r_[0, np.cumsum([r[1] for r in counts])]
    offsets = spark.createDataFrame([(r[0], int(b)) for r, b in zip(counts, begins)], "part long, begin long")
    ranked = blocks.join(F.broadcast(offsets), "part").withColumn("rank", F.col("begin") + F.col("nth"))
    pairs = written(near_intervals(ranked.select("rank", "low", "high"), int(begins[-1]), eps), "grid-pairs")
    band = max(1, min(MAX_BAND, int(begins[-1]) // 4, BAND_BYTES // (2 * BLOCK * dims * 8)))
    pairs = pairs.select("a", "b", F.expr(f"a div {band}").alias("x"), F.expr(f"b div {band}").alias("y"))
    todo = pairs.groupBy("x", "y").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))  # at most band * band
    needed = pairs.select("x", "y", F.explode(F.array("a", "b")).alias("rank")).distinct().join(todo, ["x", "y"])
    data = needed.join(ranked.select("rank", "nodes", "copies", "sizes", "data"), "rank")
    number = "<f4" if "float" in kind else "<f8"
    found = written(data.groupBy("x", "y").applyInArrow(_joiner(cosine, number), "node long, links long, root long"), "vector-links")
    reached = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    low = component_minimum(sequence.select("node", "first"), reached, "first").withColumnRenamed("first", "component_id")
    linked = sequence.select("vec", "node", "copies").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(low, "node")
    result = linked.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # Vectors that link with nothing do not meet in the join.
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    result = written(result, "vector-components")  # so that the join below has exchanges of its own, which a hot vector can split
    out = rows.where("vec is not null").join(result, "vec", "left").select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.dst FROM reach r JOIN links l ON r.seen = l.src
), parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), degree AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN parts ON node = e.vec_id LEFT JOIN degree ON src = e.vec_id
"""
