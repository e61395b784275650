"""Kept and rejected rows written in one pass, counted as they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEPT, OTHER = "kept", "other"
OUTCOME = "outcome"


def write_outcomes(df: DataFrame, path: str, reasons: Sequence[str] = (), reason: str = "reject_reason", fmt: str = "parquet",
                   mode: str = "overwrite") -> dict[str, int]:
    """Write all rows of ``df`` partitioned by outcome, ``kept`` or their reject reason, and
    return the rows of each outcome.

    The plan runs once: both sides come from the same pass, and the counts are metrics
    observed during the write, not a second job. ``reasons`` names the reasons to count
    one by one; rows of any other are counted together as ``other``, and written under
    their own name all the same. Rows go where they lie, with no shuffle.
    """
    if OUTCOME in df.columns:
        raise ValueError(f"column {OUTCOME} exists already")
    why = F.coalesce(F.col(reason), F.lit(KEPT))
    named = [KEPT, *reasons]
    seen = Observation(f"outcomes of {path}")
    counts = [F.count_if(why == name).alias(f"n{k}") for k, name in enumerate(named)]
    counted = df.observe(seen, F.count(F.lit(1)).alias("all"), *counts)
    counted.withColumn(OUTCOME, why).drop(reason).write.mode(mode).partitionBy(OUTCOME).format(fmt).save(path)
    got = seen.get
    out = {name: got[f"n{k}"] or 0 for k, name in enumerate(named)}
    rest = (got["all"] or 0) - sum(out.values())
    return {**out, **({OTHER: rest} if rest else {})}


def read_outcomes(spark: SparkSession, path: str, schema: str, outcomes: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Rows written by :func:`write_outcomes` with their ``outcome``; with ``outcomes`` only
    the folders of these are read. ``schema`` is that of the written rows."""
    out = spark.read.schema(f"{schema}, {OUTCOME} string").format(fmt).load(path)
    return out if outcomes is None else out.where(F.col(OUTCOME).isin(list(outcomes)))
