"""Session settings that the operators assume."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def get_spark(app_name: str = "millrace", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution on.

    Workers run the interpreter of the driver: the variable must be set before the JVM starts.
    ``shuffle_partitions`` is left to the cluster's setting where it isn't given.
    """
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | settings
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
