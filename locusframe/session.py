"""Session defaults. Every operator works with any session; these are what the package's own runs use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()
