"""What several operators share: written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only where that is unset, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if "dir" not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-locusframe-")
    return _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and runs Python once.

    An RDD checkpoint would run the plan twice; a written table runs it once and stays columnar.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most ``n`` rows by hash of ``cols``, the same ones each time; a threshold first, so tasks send few rows each."""
    total = df.count()
    order = F.xxhash64(*cols)
    few = df if total <= 2 * n else df.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 2 * n / total))
    return few.orderBy(order, *cols).limit(n)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name."""
    return reduce(DataFrame.unionByName, dfs)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) links in any order -> (node, component): each linked node and its component's smallest node.

    Alternates large-star and small-star contraction. Every step is a map-side combined minimum and an equi-join
    against one row per node, so a hub with many links is split by skew-join handling, never gathered.
    Null ends and self-links are ignored; an empty table gives an empty table.
    """
    edges = (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    edges = written(edges, "links")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = (
            both.join(low, "src").where(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        )
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(
            F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct(F.col("src"), F.col("low").alias("dst")))).alias("e")
        )
        edges = written(small.select("e.src", "e.dst").where(F.col("src") != F.col("dst")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return (
        edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        .unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
    )


SALTS = 16


def component_minimum(nodes: DataFrame, reached: DataFrame, value: str) -> DataFrame:
    """``nodes`` (node, value) with the smallest ``value`` of the node's component (``reached``: node, component).

    Only linked nodes meet their component, whose one row is repeated for each salt, so a component of any size spreads
    over tasks. Nodes that nothing reaches keep their value; nulls are passed over as smallest.
    """
    linked = nodes.join(reached, "node")
    low = linked.groupBy("component").agg(F.min(value).alias("__low")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lowest = linked.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(low, ["component", "__salt"]).select("node", "__low", F.lit(True).alias("__linked"))
    return nodes.join(lowest, "node", "left").select("node", F.when(F.col("__linked"), F.col("__low")).otherwise(F.col(value)).alias(value))


#: DuckDB: a CTE's body with CRC-32's table (``crc_table.t``), and the checksum of a text's UTF-8 bytes by it.
CRC_TABLE_SQL = """
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)"""


def crc_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of ``text``, which must not be empty; null for null."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT"""
