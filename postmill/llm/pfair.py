"""Mixing sources to target weights by proportionate-fair scheduling (operator 9).

Documents of a source form blocks. A source of weight w (all weights add up to 1) gives
its j-th block the release time floor(j / w) and the deadline ceil((j + 1) / w); among
the released blocks the earliest deadline takes the next slot. Every block then lies in
its window, so at any time each source is less than one block away from its target.
Weights are exact fractions, so nothing is rounded and no window drifts.

The earliest deadline is a choice among sources, not rows: the driver steps through the
blocks with one counter a source and keeps the counters once every SEGMENT blocks. From
there tasks step through their segment again and give back the slot of each block. When
a source runs out, its later slots stay empty and the order closes up over them, which
keeps the others' ratios.

With a ``period`` of D slots, targets are whole slots n of it, with windows from
floor(j * D / n) to ceil((j + 1) * D / n). The schedule of one period then fixes the slot
of every block: block b takes slot (b div n) * D + slot of block (b mod n).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postmill.llm.common import checkpointed

PERIOD = 1000        # slots of a period, at least, where whole slots are asked for
SEGMENT = 65_536     # blocks that a task places, at least
BLOCK_DOCS = 16      # documents of a block
ALPHA = 0.5          # default targets: source sizes to this power
BUCKET_ROWS = 65_536
LEAST_BUCKETS = 256


def slot_shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots a period for each source, in proportion to its weight, one at least.

    Largest remainders are rounded up; equal ones go to the first source in order. The
    period is raised to four slots a source where that is more.
    """
    if not weights:
        return {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be over 0")
    period, least = max(period, 4 * len(weights)), set()
    while True:  # sources under one slot get one, the others share the rest by weight
        spare, total = period - len(least), sum(w for s, w in weights.items() if s not in least)
        exact = {s: 1.0 if s in least else spare * w / total for s, w in weights.items()}
        if min(exact.values()) >= 1:
            break
        least |= {s for s, x in exact.items() if x < 1}
    shares = {s: int(x) for s, x in exact.items()}
    by_rest = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in by_rest[:period - sum(shares.values())]:
        shares[s] += 1
    return shares


def edf_period(shares: dict[str, int]) -> list[str]:
    """The source of each slot of a period: earliest deadline first among released blocks."""
    period, ready, out = sum(shares.values()), [], []
    waiting = [(0, s, 0) for s in shares]
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * period // shares[s], s, j + 1))
    return out


def _schedule(spark: SparkSession, shares: dict[str, int]) -> DataFrame:
    """(mix_key, share, block_in_period, period_slot): one row a slot of the period."""
    seen: dict[str, int] = {}
    rows = []
    for slot, s in enumerate(edf_period(shares)):
        rows.append((s, shares[s], seen.setdefault(s, 0), slot))
        seen[s] += 1
    return spark.createDataFrame(rows, "mix_key string, share long, block_in_period long, period_slot long")


class Blocks:
    """Earliest deadline first over all blocks of all sources, in windows from exact weights.

    ``done`` says how many blocks of each source are placed before ``slot``; that is the
    whole state, so stepping can go on from any of its copies.
    """

    def __init__(self, weights: list[float], blocks: list[int], slot: int = 0, done: list[int] | None = None):
        exact = [Fraction(w) for w in weights]
        scale = lcm(*[w.denominator for w in exact])
        self.shares = [int(w * scale) for w in exact]  # of `whole`, without rounding
        self.whole, self.blocks, self.slot = sum(self.shares), blocks, slot
        self.done = list(done) if done is not None else [0] * len(blocks)
        self.ready: list[tuple[int, int]] = []
        self.waiting = [(j * self.whole // self.shares[s], s) for s, j in enumerate(self.done) if j < blocks[s]]
        heapq.heapify(self.waiting)

    def step(self, count: int) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot) of the next ``count`` blocks."""
        ready, waiting, done, shares, whole = self.ready, self.waiting, self.done, self.shares, self.whole
        for _ in range(count):
            if not ready:
                if not waiting:
                    return
                self.slot = max(self.slot, waiting[0][0])
            while waiting and waiting[0][0] <= self.slot:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[s] + 1) * whole // shares[s]), s))
            s = heapq.heappop(ready)[1]
            yield s, done[s], self.slot
            self.slot += 1
            done[s] += 1
            if done[s] < self.blocks[s]:
                heapq.heappush(waiting, (done[s] * whole // shares[s], s))


def _block_slots(spark: SparkSession, target: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """(mix_key, mix_block, mix_slot) of every block."""
    if any(not w > 0 for w in target.values()):
        raise ValueError("weights must be over 0")
    names = sorted(target)
    weights, sizes = [target[s] for s in names], [blocks[s] for s in names]
    size = max(SEGMENT, 16 * len(names))  # so all counters kept are fewer than the blocks by far
    run, starts = Blocks(weights, sizes), []
    for _ in range(-(-sum(sizes) // size)):
        starts.append((run.slot, list(run.done)))
        for _ in run.step(size):
            pass

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(names, object)
        for batch in batches:
            for start in batch.to_pylist():
                placed = list(Blocks(weights, sizes, start["slot"], start["done"]).step(size))
                s, b, t = (list(x) for x in zip(*placed))
                yield pa.RecordBatch.from_arrays([pa.array(table[s], pa.string()), pa.array(b, pa.int64()), pa.array(t, pa.int64())],
                                                 names=["mix_key", "mix_block", "mix_slot"])

    return spark.createDataFrame(starts, "slot long, done array<long>").mapInArrow(place, "mix_key string, mix_block long, mix_slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id",
        text_col: str = "text", block_docs: int = BLOCK_DOCS, period: int | None = None, seed: int = 17,
        keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``keep``, default all) with its place in the mix.

    ``mix_block`` is the block's number within its source, ``mix_slot`` its slot and
    ``mix_offset`` the row's place in the block; (mix_slot, mix_offset) orders the corpus.
    Within a source, rows are in the order of a seeded hash of id and text. Without
    ``weights`` the targets are source sizes to the power ALPHA; a source that
    ``weights`` leaves out gets the smallest given weight. Targets are exact, or with a
    ``period`` whole slots of it (see ``slot_shares``). A null source is a source of its own; null ids and
    texts and repeated rows each keep a place; no row is dropped or repeated. Columns of
    ``docs`` named like the three new ones give way to them.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("mix_block", "mix_slot", "mix_offset")]
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in keep]).alias("row"),
                       F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("")).alias("mix_key"),
                       F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]).alias("mix_hash"))
    total = rows.count()
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    # buckets follow the order of the hash, so a source's order is bucket by bucket
    bucket = F.shiftright((F.shiftright("mix_hash", 32) + F.lit(2**31)) * F.lit(buckets), 32)
    rows = rows.withColumn("mix_bucket", bucket)
    counts = checkpointed(rows.groupBy("mix_key", "mix_bucket").agg(F.count("*").alias("n")))
    sizes = {r["mix_key"]: r["n"] for r in counts.groupBy("mix_key").agg(F.sum("n").alias("n")).collect()}
    if weights is None:
        target = {s: n**ALPHA for s, n in sizes.items()}
    else:
        given = {f"={s}": w for s, w in weights.items()}
        target = {s: given.get(s, min(given.values(), default=1.0)) for s in sizes}
    before = Window.partitionBy("mix_key").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_key", "mix_bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    first, last = (F.floor(c / block_docs).cast("long") for c in (F.col("mix_before"), F.col("mix_before") + F.col("n") - 1))
    if period is None:
        # a bucket's rows lie in consecutive blocks, whose slots it gets as one array
        slots = _block_slots(spark, target, {s: -(-n // block_docs) for s, n in sizes.items()})
        each = offsets.select("mix_key", "mix_bucket", "mix_before", F.explode(F.sequence(first, last)).alias("mix_block"))
        offsets = (each.join(slots, ["mix_key", "mix_block"]).groupBy("mix_key", "mix_bucket", "mix_before")
                   .agg(F.transform(F.array_sort(F.collect_list(F.struct("mix_block", "mix_slot"))), lambda x: x["mix_slot"]).alias("mix_slots")))
    inside = Window.partitionBy("mix_key", "mix_bucket").orderBy("mix_hash")
    index = F.col("mix_before") + F.col("mix_rank") - 1
    placed = (rows.withColumn("mix_rank", F.row_number().over(inside)).join(offsets, ["mix_key", "mix_bucket"])
              .withColumn("mix_block", F.floor(index / block_docs).cast("long"))
              .withColumn("mix_offset", F.pmod(index, F.lit(block_docs)).cast("int")))
    if period is None:
        at = F.col("mix_block") - F.floor(F.col("mix_before") / block_docs).cast("long")
        placed = placed.withColumn("mix_slot", F.get("mix_slots", at.cast("int")))
    else:
        shares, share, at = slot_shares(target, period), F.col("share"), F.col("mix_block")
        plan = _schedule(spark, shares)
        # the plan has a row for each slot of the period, which is a parameter (or four a source)
        sized = F.broadcast(plan.select("mix_key", "share").distinct())
        placed = (placed.join(sized, "mix_key").withColumn("block_in_period", F.pmod(at, share))
                  .join(F.broadcast(plan.drop("share")), ["mix_key", "block_in_period"])
                  .withColumn("mix_slot", F.floor(at / share).cast("long") * sum(shares.values()) + F.col("period_slot")))
    return placed.select(*[F.col("row")[c].alias(c) for c in keep], "mix_block", "mix_slot", "mix_offset")


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted by their place, so that written files follow the mix."""
    return mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
