"""Spark session construction and shared settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI semantics are kept (Spark 4 default), so
# operators use try_* functions; UTC keeps event-time windows engine-neutral.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "postmill") -> SparkSession:
    """Create (or reuse) a session. On a cluster pass master=None and let the
    launcher decide; tests pass local[N]."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("POSTMILL_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    let_workers_import(spark)
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Python workers on this machine find the package wherever the driver was started;
    on a cluster it is shipped as usual (--py-files or an installed package)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
