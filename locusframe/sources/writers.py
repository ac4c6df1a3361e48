"""Sinks. The file committer publishes all files of a write or none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_windows(df: DataFrame, path: str, rows_per_file: int = 4096, by: str = "accession") -> None:
    """Parquet in a folder per ``by``, at most so many rows a file; null ``by`` has a folder of its own."""
    df.write.partitionBy(by).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: tuple[str, ...] = ("chrom", "start_pos", "end_pos")) -> None:
    """Files in coordinate order, each sorted."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines; null fields are left out."""
    df.write.option("compression", "gzip").json(path)


def cached(spark: SparkSession, path: str, build: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written there first if it is not readable as Parquet yet."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")):
        build(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256, collection) of each part file; collection is the digest over names and digests in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    whole = rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat_ws(":", x["name"], x["sha256"])), "\n"), 256).alias("collection"))
    return rows.crossJoin(F.broadcast(whole))
