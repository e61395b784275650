"""Skew-safe prefix sums and global indexes.

A plain ``sum() OVER (PARTITION BY g ORDER BY o)`` sends a whole group to one
task, and a window without PARTITION BY sends the whole table to one task.
Here the order is cut into chunks: chunk totals are aggregated (map-side
combined), offsets are a prefix sum over the much smaller chunk table, and
rows get ``chunk offset + running sum inside the chunk``. A hot group is spread
over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], order: str, value, out,
                chunk: int = 4096, chunk_col: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``group`` with order
    key <= this row's (``inclusive``) or < (exclusive). ``value``/``out`` may be
    lists to compute several sums in one pass. ``order`` must be unique inside a
    group. ``chunk_col`` must be monotone in ``order``; by default it is
    ``order div chunk`` (for dense integer keys)."""
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    ck = chunk_col if chunk_col is not None else F.floor(F.col(order) / F.lit(chunk))
    d = df.withColumn("_ck", ck)
    totals = d.groupBy(*group, "_ck").agg(*[F.sum(v).alias(f"_ctot{i}") for i, v in enumerate(values)])
    w_chunks = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_ck") \
        .rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "_ck", *[F.coalesce(F.sum(f"_ctot{i}").over(w_chunks), F.lit(0)).alias(f"_cbase{i}")
                                            for i in range(len(values))])
    w_rows = Window.partitionBy(*group, "_ck").orderBy(order)
    w_rows = w_rows.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = d.select("*", *[F.coalesce(F.sum(v).over(w_rows), F.lit(0)).alias(f"_local{i}")
                            for i, v in enumerate(values)])
    res = local.join(bases, [*group, "_ck"], "inner")
    res = res.select("*", *[(F.col(f"_cbase{i}") + F.col(f"_local{i}")).alias(o) for i, o in enumerate(outs)])
    return res.drop("_ck", *[f"_cbase{i}" for i in range(len(values))], *[f"_local{i}" for i in range(len(values))])


def hash_bucket(h: Column, bits: int = 16) -> Column:
    """Leading ``bits`` of a hex digest as an int bucket (monotone in the digest)."""
    digits = max(1, bits // 4)
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def global_index(df: DataFrame, order_key: Column, tie: str, out: str = "idx",
                 partition: list[str] | None = None, bits: int = 16) -> DataFrame:
    """0-based position of each row when sorted by (``order_key``, ``tie``).

    ``order_key`` must be a hex digest (uniform), so the leading-digit buckets
    are balanced; positions are bucket offsets plus a row number inside the
    bucket. No unpartitioned window over the data.
    """
    partition = partition or []
    d = df.withColumn("_ok", order_key).withColumn("_one", F.lit(1))
    d = d.withColumn("_ord", F.struct("_ok", F.col(tie)))
    bucket = hash_bucket(F.col("_ok"), bits)
    # Bucket offsets from bucket counts (at most 2**bits rows per partition key).
    counts = d.groupBy(*partition, bucket.alias("_ck")).agg(F.count(F.lit(1)).alias("_n"))
    wb = (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy("_ck") \
        .rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*partition, "_ck", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_base"))
    wr = Window.partitionBy(*partition, "_ck").orderBy("_ok", tie)
    rows = d.withColumn("_ck", bucket).withColumn("_rn", F.row_number().over(wr))
    return (rows.join(bases, [*partition, "_ck"], "inner")
                .withColumn(out, (F.col("_base") + F.col("_rn") - 1).cast("bigint"))
                .drop("_ok", "_one", "_ord", "_ck", "_rn", "_base"))
