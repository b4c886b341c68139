"""SparkSession factory with the settings the engine's semantics rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tastevin", cpus: int | str = "*", **extra: str) -> SparkSession:
    """Local session for tests and benches; on a cluster spark-submit supplies master and sizes."""
    builder = SparkSession.builder.appName(app).master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
    for k, v in {**DEFAULTS, **extra}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    return spark
