"""Structured Streaming over a growing directory of window shards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from locusframe.operators.windows import scan_windows


def stream_windows(spark: SparkSession, path: str, schema: StructType, include: Sequence[str] = (), exclude: Sequence[str] = (), splits: Sequence[str] = (), key: str = "example_id", time: str | None = None, late: str = "7 days") -> DataFrame:
    """New windows as they arrive, filtered and once per id. With an event time the id state is bounded by its watermark;
    without one it holds every id, so long streams take ``arriving_windows`` and a ``OncePerId`` sink instead."""
    rows = scan_windows(spark.readStream.schema(schema).parquet(path), include, exclude, splits)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def arriving_windows(spark: SparkSession, path: str, schema: StructType, include: Sequence[str] = (), exclude: Sequence[str] = (), splits: Sequence[str] = ()) -> DataFrame:
    """New windows as they arrive, filtered, ids as often as they come: a stream without state."""
    return scan_windows(spark.readStream.schema(schema).parquet(path), include, exclude, splits)


class OncePerId:
    """A batch sink that passes each id on once in the life of the stream, with no state in the stream.

    The ids of each batch are written to ``path``, a folder a batch; a batch is held against those of earlier batches by an
    anti-join, so no task holds more than its share of the ids, and what is kept is a key an id, whatever the rows hold. A
    batch that is replayed is held against the same earlier batches and overwrites its own ids, so ``sink`` gets the same
    rows again, to be written under the same batch number. Of rows that share an id in a batch one is passed on; a null id
    is an id.
    """

    def __init__(self, path: str, key: str, sink: Callable[[DataFrame, int], None]):
        self.path, self.key, self.sink = path.rstrip("/"), key, sink

    def _before(self, rows: DataFrame, batch: int) -> DataFrame | None:
        spark = rows.sparkSession
        here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here):
            return None
        ids = spark.read.schema(f"`{self.key}` {rows.schema[self.key].dataType.simpleString()}, batch long").parquet(self.path)
        return ids.where(F.col("batch") < batch).select(F.col(self.key).alias("__seen"))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows = rows.dropDuplicates([self.key])
        before = self._before(rows, batch)
        if before is not None:
            rows = rows.join(before, rows[self.key].eqNullSafe(F.col("__seen")), "left_anti")
        rows = rows.persist()
        rows.select(self.key).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self.sink(rows, batch)
        rows.unpersist()


def split_totals(rows: DataFrame) -> DataFrame:
    """(split, sample_group, n); nulls are values of their own."""
    return rows.groupBy("split", "sample_group").agg(F.count("*").alias("n"))


def stream_leakage(rows: DataFrame, held_out: Sequence[str]) -> DataFrame:
    """(sample_group, families, leak) in update mode: the split families of each group so far; leak when both meet."""
    family = F.when(F.col("split").isin(*held_out), "held_out").otherwise("development")
    out = rows.groupBy("sample_group").agg(F.array_sort(F.collect_set(family)).alias("families"))
    return out.withColumn("leak", F.size("families") > 1)


def run_once(rows: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what is there and stop; each batch goes to ``sink`` once per checkpoint."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query
