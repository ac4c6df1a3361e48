"""Running totals over rows in order. Rows are cut by range into slices of a bounded number of rows, so the number of
slices follows the table and no group, however large, meets in one task; what a slice takes over is summed over slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType

from locusframe.operators.iterate import written

#: Rows a slice, and rows up to which a table is ordered as one slice without being written.
ROWS, ALONE = 1_000_000, 200_000

_HOW = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def sliced(df: DataFrame, order: Sequence[str | Column], rows: int | None = None, alone: bool = False, name: str = "slices") -> DataFrame:
    """``df`` with ``__slice`` (an int; a byte if it is the only one), the number of its range of ``order`` (nulls first), about ``rows`` (ROWS) rows each, written.

    Rows that are equal in all of ``order`` share a slice. With ``alone``, up to ALONE rows are one slice and are not written.
    An empty table gives an empty table.
    """
    total = df.count()
    if alone and total <= ALONE:
        return df.withColumn("__slice", F.lit(0).cast("byte"))
    if alone:
        df = written(df, f"{name}-rows")  # ordering reads it twice
    return written(df.repartitionByRange(max(1, -(-total // (rows or ROWS))), *order).withColumn("__slice", F.spark_partition_id()), name)


def carried(cut: DataFrame, keys: Sequence[str], order: Sequence[str | Column], totals: Mapping[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """``cut``, made by ``sliced`` over keys and order, with each of ``totals``: (sum, max or min; column) over the key's rows
    up to and with each row, or up to and without it if ``before``.

    Null keys are a key; nulls come first in order and add nothing; a total is null until a value comes. Rows that tie in
    ``order`` come in any order, so name enough columns.
    """
    keys, names = list(keys), list(totals)
    here = Window.partitionBy("__slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = cut.withColumns({k: _HOW[how][0](v).over(here) for k, (how, v) in totals.items()})
    if cut.schema["__slice"].dataType == ByteType():  # one slice
        return local
    whole = cut.groupBy("__slice", *keys).agg(*[_HOW[how][0](v).alias(f"__w_{k}") for k, (how, v) in totals.items()])
    ahead = Window.partitionBy(*keys, F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice of the key
    earlier = whole.select(F.col("__slice").alias("__of"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[_HOW[how][0](f"__w_{k}").over(ahead).alias(f"__c_{k}") for k, (how, _) in totals.items()])
    earlier = earlier.where(reduce(Column.__or__, [F.col(f"__c_{k}").isNotNull() for k in names]))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__slice") == F.col("__of"))
    out = local.join(earlier, same, "left").withColumns({k: _HOW[how][1](F.col(f"__c_{k}"), F.col(k)) for k, (how, _) in totals.items()})
    return out.select(*cut.columns, *names)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], totals: Mapping[str, Column], how: str = "sum", rows: int | None = None, alone: bool = False, before: bool = False) -> DataFrame:
    """``df`` with ``totals`` as ``carried`` gives them. ``df`` is counted and ordered once each: pass a cheap plan, or allow
    tables of up to ALONE rows to be ordered as one slice by ``alone``."""
    cut = sliced(df, [*keys, *order], rows, alone, "scan")
    return carried(cut, keys, order, {k: (how, v) for k, v in totals.items()}, before).drop("__slice")
