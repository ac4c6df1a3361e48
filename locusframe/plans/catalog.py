"""Every registered query of the analytics operators, with the SQL it is compared with.

A query takes a function that gives a view by name; all its rows come from the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from locusframe.plans.fixtures import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(partial(view, spark, sf_dir))
        if sql:
            SQL[name] = duck(sql)
        return build

    return wrap


from locusframe.plans import queries_audit, queries_intervals, queries_io, queries_matrix, queries_rank, queries_seq, queries_stats, queries_windows  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_loci"](spark, sf_dir)
