"""Folders that driver and executors share, for tables written and read again within a job."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one, as in tests,
    uses a temporary folder, since no other machine has to see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or os.path.join(tempfile.gettempdir(), "postmill")).rstrip("/")


class RunFolder:
    """A new folder under the shared root; it goes when the driver ends, as results that read
    it may still be evaluated until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove)

    def at(self, *parts: str) -> str:
        return "/".join([self.path, *parts])

    def _remove(self) -> None:
        sc = self.spark.sparkContext
        if getattr(sc, "_jsc", None) is None or sc._jsc.sc().isStopped():
            return
        where = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
