"""SparkSession factory used by the bench and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(cpus: int | str | None = None, app: str = "threadloom", **conf: str) -> SparkSession:
    """A local session with the settings that every query expects (UTC, AQE)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        # One machine, so its temporary folder is shared by all; a cluster's setting takes its place.
        "spark.checkpoint.dir": "file://" + os.path.join(tempfile.gettempdir(), "threadloom-checkpoints"),
    }
    settings.update(conf)
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
