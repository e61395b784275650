"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEAVY_KEYS = 4096  # keys that hold over 1/HEAVY_KEYS of the rows: fewer than HEAVY_KEYS by counting


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (local tests) a temporary one is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (shared or os.path.join(tempfile.gettempdir(), "postmill-llm")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables in the shared folder, for loops over tables.

    Unlike a checkpoint, a table read again brings its real size. A checkpointed frame
    keeps the size that the planner estimated, a join's being the product of its
    inputs', so in a loop of joins the estimate squares itself in every round until
    its digits alone fill the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.paths, self.made, self.kept_any = [], 0, False

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def clear(self, *kept: DataFrame) -> None:
        """Delete all tables but ``kept``, which a result still reads; those go with the driver."""
        names = {df._scratch_path for df in kept}
        for path in [p for p in self.paths if p not in names]:
            self._delete(path)
        self.paths = sorted(names)
        if names and not self.kept_any:
            atexit.register(self._at_exit)
            self.kept_any = True

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._delete(self.folder)


def doc_key(id_col: Column, text_col: Column) -> list[Column]:
    """A document's identity: its id (may be null or repeated) and a hash of its text.

    Rows that agree in both are the same document repeated; every decision taken here
    is a function of the text, so they share it. The id spreads exact copies.
    """
    return [id_col.cast("long").alias("k_id"), F.xxhash64(text_col).alias("k_text")]


def join_on_doc_key(left: DataFrame, right: DataFrame, how: str, grows: bool = True) -> DataFrame:
    """Join on (k_id, k_text), null ids meeting null ids; the key columns stay once.

    The right side is a set of documents; if it ``grows`` with them, it is never broadcast.
    """
    r = right.withColumnsRenamed({"k_id": "r_id", "k_text": "r_text"})
    r = r.hint("merge") if grows else r
    out = left.join(r, (F.col("k_text") == F.col("r_text")) & F.col("k_id").eqNullSafe(F.col("r_id")), how)
    return out if how in ("left_semi", "left_anti") else out.drop("r_id", "r_text")


def hash_sample(df: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """At most ``size`` of the ``total`` rows, by a hash of ``key``.

    Rows are chosen where they lie, so neither the driver nor one task sees more than the
    sample however many partitions there are; the limit only holds off repeated keys.
    """
    share = 1.0 if total <= size else 0.9 * size / total
    cutoff = min(2**63 - 1, int(-2**63 + share * 2**64))
    return df.filter(F.xxhash64(F.lit(size), key) <= F.lit(cutoff)).limit(size)


def slices(texts: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(start, size) runs of rows that hold about ``limit`` bytes of text each, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > limit:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts) - start


def give_back() -> None:
    """Return freed memory to the system at the end of a task: a Python worker lives on, and
    what it once held would count against its executor through all later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
