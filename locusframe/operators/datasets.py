"""Labelled training sets from interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.intervals import background_loci, overlap_max
from locusframe.operators.iterate import written
from locusframe.operators.windows import hash_order


def labelled_windows(candidates: DataFrame, signal: DataFrame, sizes: DataFrame, key: str, negatives: int, width: int, seed: int = 0) -> DataFrame:
    """(key, chrom, start_pos, end_pos, active, target): active windows have signal; negatives are half inactive candidates
    and half background that touches none; target is log1p of the signal over its largest. ``negatives`` bounds the draw by intent."""
    best = overlap_max(candidates, signal, "signal", key).select(F.col(key).cast("string").alias(key), "chrom", "start_pos", "end_pos", "best")
    best = written(best, "best")  # read three times
    active = best.where("best > 0")
    idle = best.where("best <= 0").orderBy(hash_order(seed, key), key).limit(negatives // 2)
    ground = background_loci(sizes, signal, negatives - negatives // 2, width, seed).select(F.col("place").alias(key), "chrom", "start_pos", "end_pos", F.lit(0.0).alias("best"))
    rows = active.unionByName(idle).unionByName(ground)
    top = active.agg(F.max(F.log1p("best")).alias("__top"))
    return rows.crossJoin(F.broadcast(top)).select(key, "chrom", "start_pos", "end_pos", (F.col("best") > 0).alias("active"), F.when(F.col("__top") > 0, F.log1p("best") / F.col("__top")).otherwise(0.0).alias("target"))
