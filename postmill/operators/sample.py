"""Sampling, ordering and batching (E1-E4). Every "first/last/limit" has an
explicit order; nothing depends on file or partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.plans.scan import global_index


def seeded_key(seed, *cols) -> Column:
    """Reproducible uniform sort key: md5 of ``seed:col1:col2...``."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


BUCKETS = 64


def top_n(df: DataFrame, n: int, order: list[Column], spread_by: list[Column]) -> DataFrame:
    """First ``n`` rows by ``order``, one plan for every size.

    The first step keeps n rows of each of BUCKETS hash buckets (limited before the
    shuffle too), so the last merge reads BUCKETS * n rows however many splits the
    input has. ``order`` must say where nulls go."""
    w = Window.partitionBy("_bucket").orderBy(*order)
    kept = (df.withColumn("_bucket", F.pmod(F.xxhash64(*spread_by), F.lit(BUCKETS)))
              .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank", "_bucket"))
    return kept.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Shuffle with ``seed`` and take ``n`` rows (E1): the first n rows by
    md5(seed:id), id; null ids come last."""
    return top_n(df, n, [seeded_key(seed, id_col), F.col(id_col).asc_nulls_last()], [F.col(id_col)])


def first_n(df: DataFrame, n: int, order_col: str, where: Column | None = None) -> DataFrame:
    """First ``n`` rows by ``order_col`` among rows passing ``where`` (E2). Any
    orderable column; nulls come last. ``where`` ranks rows instead of filtering the
    input, so a costly condition is evaluated once, where its columns are."""
    order = F.col(order_col).asc_nulls_last()
    if where is None:
        return top_n(df, n, [order], [F.col(order_col)])
    d = df.withColumn("_passes", F.coalesce(where, F.lit(False)))
    return top_n(d, n, [F.col("_passes").desc(), order], [F.col(order_col)]).where("_passes").drop("_passes")


def last_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """Last ``n`` rows by ``order_col`` (E3); nulls are never among the last
    while other rows are left."""
    return top_n(df, n, [F.col(order_col).desc_nulls_last()], [F.col(order_col)])


def epoch_batches(df: DataFrame, id_col: str, epochs: int, batch_size: int, seed: int) -> DataFrame:
    """Per-epoch shuffle and batch assignment (E4): ``idx`` is the 0-based
    position in the epoch's order, ``batch_id = idx div batch_size`` (the last
    batch may be short). Positions come from hash-bucket offsets, never from an
    unpartitioned window."""
    # One row per (row, epoch): a generator over the epoch list, no join.
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = global_index(rows, seeded_key(seed, "epoch", id_col), id_col, out="idx", partition=["epoch"])
    return rows.withColumn("batch_id", F.floor(F.col("idx") / batch_size).cast("bigint"))
