"""Session construction and the few settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. A running session is returned as it is, with none of its settings touched.

    Neither a master nor a number of shuffle partitions is set unless asked for, so what the submitter gives holds; only a plain Python process, which nothing was submitted
    to, gets ``local[$BENCH_CPUS or *]``. ``conf``: further settings, ``__`` for ``.``.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_REMOTE" in os.environ
    if master or not submitted:
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '*')}]").config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
