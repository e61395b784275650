"""Blocks of vectors, and a query set searched against all of them block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
LEAST_SLOTS, MOST_SLOTS = 8, 1024

RAW = "vec_id long, vec binary, length double"
BLOCK = "block long, dim int, ids binary, vecs binary"


def clean(table: DataFrame, id_col: str, vec_col: str, integers: bool, zero: bool) -> DataFrame:
    """(vec_id, vec, length): vectors as packed doubles, with ``integers`` as floor(256 x).

    Rows with a null id, a null vector, or a null or non-finite component take no part;
    with ``zero`` false neither do zero (and empty) vectors.
    """
    src = table.select(table[id_col].cast("long").alias("vec_id"), table[vec_col].cast("array<double>").alias("v")).dropna()
    src = src.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        src = src.filter(F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if integers:
                flat = np.floor(256.0 * flat)
            ends = (np.asarray(batch.column(1).offsets) - batch.column(1).offsets[0].as_py()).astype(np.int64) * 8
            blob = (flat + 0.0).tobytes()
            vecs = [blob[a:b] for a, b in zip(ends, ends[1:])]
            length = np.sqrt([(x * x).sum() for x in (np.frombuffer(v, np.float64) for v in vecs)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(length, pa.float64())],
                                             names=["vec_id", "vec", "length"])

    return src.mapInArrow(run, RAW)


def matrix(vecs: list[bytes], dim: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    dim = max((len(v) // 8 for v in vecs), default=0) if dim is None else dim
    if vecs and all(len(v) == dim * 8 for v in vecs):
        return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), dim).copy()
    out = np.zeros((len(vecs), dim))
    for row, v in zip(out, vecs):
        row[:len(v) // 8] = np.frombuffer(v, np.float64)
    return out


def fit_dim(x: np.ndarray, dim: int) -> np.ndarray:
    """The same rows with ``dim`` columns, zeros added."""
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def unpack(dim: int, ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vecs, np.float64).reshape(len(ids), dim)


def pack(rows: DataFrame, size: int, arrange: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row for each run of ``size`` rows of a partition, in its order.

    Neighbouring rows that agree in id and vector are one row repeated and count once.
    ``arrange`` gives a row order within a block. Block numbers follow the partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, done, ids, vecs, last = TaskContext.get().partitionId() << 32, 0, [], [], None

        def block() -> pa.RecordBatch:
            x, i = matrix(vecs), np.array(ids, np.int64)
            if arrange is not None:
                order = arrange(x)
                x, i = x[order], i[order]
            return pa.RecordBatch.from_pydict({"block": [base + done], "dim": pa.array([x.shape[1]], pa.int32()), "ids": [i.tobytes()], "vecs": [x.tobytes()]})

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if row == last:
                    continue
                last = row
                ids.append(row[0])
                vecs.append(row[1])
                if len(ids) == size:
                    yield block()
                    done, ids, vecs = done + 1, [], []
        if ids:
            yield block()

    return rows.select("vec_id", "vec").mapInArrow(run, BLOCK)


def query_blocks(vectors: DataFrame, every: int, count: int) -> DataFrame:
    """Blocks of the ``count`` rows whose id is divisible by ``every``, full ones as far as possible."""
    chosen = vectors.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"])
    return pack(chosen.coalesce(max(1, count // QUERY_ROWS)), QUERY_ROWS)


def best_rows(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each q's k highest scores, ties to the smaller id, ordered by q and rank."""
    order = np.lexsort((ids, -score, q))
    first = np.concatenate([[True], q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def floors(q: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Each query's k-th best score so far, from rows ordered by q and rank; -inf with fewer."""
    out = np.full(n, -np.inf)
    counts = np.bincount(q, minlength=n)
    ends = np.cumsum(counts)
    full = counts >= k
    out[full] = score[ends[full] - counts[full] + k - 1]
    return out


def pick(blocks: DataFrame, number: Column) -> Row | None:
    """The one block whose number the aggregate gives; None of no blocks."""
    return blocks.filter(F.col("block") == F.lit(blocks.agg(number).first()[0])).first()


HITS = "query_id long, vec_id long, score {kind}"


def search(queries: DataFrame, blocks: DataFrame, head: Row, compare: Callable, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): each query's best rows of every block.

    ``queries`` and ``blocks`` are written tables. Every query block first meets the
    ``head`` (one row of ``blocks``, so of bounded size, broadcast), which sets the queries'
    floors. Then query blocks are dealt to slots, each copy meeting the candidate blocks
    of its slot; ``compare(q_ids, q, c_ids, c, floor)`` returns positions and
    scores of what reaches the floors. Blocks stream through a task two at a time.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((head["dim"], head["ids"], head["vecs"]))
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if kind == "long" else pa.float64())])

    def rows(q_ids, c_ids, qi, ci, score) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(c_ids[ci]), pa.array(exact(score), arrow.field(2).type)], schema=arrow)

    def exact(score):
        return np.asarray(score, np.int64) if kind == "long" else np.asarray(score, np.float64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_ids, c = unpack(*shared.value)
        for batch in batches:
            for b in batch.to_pylist():
                q_ids, q = unpack(b["dim"], b["ids"], b["vecs"])
                qi, ci, score = compare(q_ids, q, c_ids, c, np.full(len(q_ids), -np.inf))
                yield rows(q_ids, c_ids, qi, ci, score)

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_ids, c = unpack(*shared.value)
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                q_ids, q = unpack(b["dim"], b["ids"], b["vecs"])
                qi, _, score = compare(q_ids, q, c_ids, c, np.full(len(q_ids), -np.inf))
                out.append(floors(qi, np.asarray(score, np.float64), len(q_ids), k).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["block", "dim", "ids", "vecs", "floor"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = unpack(b["q_dim"], b["q_ids"], b["q_vecs"])
                c_ids, c = unpack(b["dim"], b["ids"], b["vecs"])
                qi, ci, score = compare(q_ids, q, c_ids, c, np.frombuffer(b["floor"], np.float64))
                yield rows(q_ids, c_ids, qi, ci, score)

    n_blocks = blocks.count()
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, n_blocks // 4))
    others = blocks.filter(F.col("block") != head["block"]).withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    dealt = (queries.mapInArrow(floor, BLOCK + ", floor binary")
             .select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "floor",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot")))
    met = dealt.join(others.drop("block"), "slot").select("q_dim", "q_ids", "q_vecs", "floor", "dim", "ids", "vecs")
    schema = HITS.format(kind=kind)
    return queries.mapInArrow(first, schema).union(met.mapInArrow(rest, schema))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
