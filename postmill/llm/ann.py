"""Approximate nearest neighbours by stable projections and kd-trees (operator 8).

Largest inner product becomes smallest distance when every vector gets one more
component that brings it to the largest length: |q - x|^2 = M^2 + |q|^2 - 2 q.x.
Gaussian (2-stable) projections map these to a few dimensions, where a squared projected
distance is the squared distance times a chi-square variable of that many degrees.

The index is a kd-tree over the projections: its upper levels, fitted on a bounded
sample, deal all vectors to cells; cells are cut into blocks and each block is a kd-tree
of its own, stored leaf by leaf with its projections. A query verifies vectors in full by
growing projected distance and stops when a vector as near as its k-th best would, with
probability CONFIDENCE, have shown up within the projected distance reached. So a vector
is verified if and only if it passes the test at the query's k-th best so far.

A query first searches the block that it lies in itself: the vectors nearest in projection
are verified first, which sets its floor. Queries of one cell then travel together through
the other blocks. A block whose box fails the test is passed over, and so is a leaf; in
the leaves that are left the points that pass are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postmill.llm import vecblocks as B
from postmill.llm.common import checkpointed, hash_sample

PROJECTED = 32
CONFIDENCE = 0.85   # a true neighbour is passed over with probability 1 - CONFIDENCE at most
SAMPLE = 8192       # vectors that the upper tree is fitted on, at most
SEED = 20240607
LEAF = 64
FIRST = 4           # times k vectors, nearest in projection, that set a query's first floor
QUERIES = 256       # that travel together
SLOTS = 256         # tasks that a group of queries is dealt to, at most


def chi_square_quantile(p: float, degrees: int) -> float:
    """By bisection on the series of the regularized lower incomplete gamma function."""

    def cdf(x: float) -> float:
        a, x = degrees / 2, x / 2
        term = total = 1 / a
        n = 1
        while term > total * 1e-15:
            term *= x / (a + n)
            total += term
            n += 1
        return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


class Projection:
    """The lifted space and its random directions, the same for every task."""

    def __init__(self, dim: int, longest: float, degrees: int = PROJECTED, seed: int = SEED):
        self.dim, self.longest = dim, longest
        self.directions = np.random.default_rng(seed).standard_normal((dim + 1, degrees))

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = B.fit_dim(x, self.dim)
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def split(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and their projections, which are stored behind them."""
        return held[:, :self.dim], held[:, self.dim:]

    def queries(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Projections of vectors as queries: without the component that only lifts."""
        rest = np.sqrt(np.maximum(self.longest**2 - (q * q).sum(axis=1), 0))
        return p - rest[:, None] * self.directions[-1]


def kd_order(p: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Row order of a kd-tree's leaves: median splits on the widest axis, halves a multiple of ``leaf``."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        axis = int(np.ptp(p[rows], axis=0).argmax())
        half = max(leaf, (len(rows) // 2) // leaf * leaf)
        split = np.argpartition(p[rows, axis], half)
        todo += [rows[split[half:]], rows[split[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class UpperTree:
    """Median splits of a sample; a row's cell is found by walking the splits."""

    def __init__(self, p: np.ndarray, levels: int):
        self.levels, n = levels, 2**levels - 1
        self.axis, self.at = np.zeros(n, np.int64), np.zeros(n)
        parts = {0: p}
        for node in range(n):
            rows = parts.pop(node)
            if len(rows):
                self.axis[node] = int(np.ptp(rows, axis=0).argmax())
                self.at[node] = np.median(rows[:, self.axis[node]])
            left = rows[:, self.axis[node]] <= self.at[node]
            parts[2 * node + 1], parts[2 * node + 2] = rows[left], rows[~left]

    def cells(self, p: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(p), np.int64), np.arange(len(p))
        for _ in range(self.levels):
            node = 2 * node + 1 + (p[rows, self.axis[node]] > self.at[node])
        return node - (2**self.levels - 1)


def in_cells(vectors: DataFrame, proj: Projection, tree: UpperTree) -> DataFrame:
    """The vectors, each followed by its projections, with their cell of the upper tree."""
    shared = vectors.sparkSession.sparkContext.broadcast((proj, tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proj, tree = shared.value
        for batch in batches:
            x = B.matrix(batch.column(1).to_pylist(), proj.dim)
            p = proj.vectors(x)
            held = pa.array([row.tobytes() for row in np.hstack([x, p])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(tree.cells(p))], names=["vec_id", "vec", "cell"])

    return vectors.mapInArrow(run, "vec_id long, vec binary, cell long")


class Searcher:
    """Search of one block at a time. ``scored`` counts verified pairs and ``met`` all pairs."""

    def __init__(self, proj: Projection, k: int, confidence: float = CONFIDENCE, leaf: int = LEAF):
        self.proj, self.k, self.leaf = proj, k, leaf
        self.reach = chi_square_quantile(confidence, proj.directions.shape[1])
        self.scored = self.met = 0

    def block(self, q_ids: np.ndarray, q_held: np.ndarray, c_ids: np.ndarray, c_held: np.ndarray, floor: np.ndarray):
        """(positions of queries, positions of candidates, exact scores) of each query's best
        rows of the block that reach its floor."""
        proj, k, leaf = self.proj, self.k, self.leaf
        (q, qp), (c, p) = proj.split(q_held), proj.split(c_held)
        pq, q_sq, floor = proj.queries(q, qp), (q * q).sum(axis=1), floor.copy()
        pq_sq, p_sq = (pq * pq).sum(axis=1), (p * p).sum(axis=1)
        self.met += len(q) * len(c)

        def limit(rows: np.ndarray) -> np.ndarray:
            # of the squared projected distance; endless while a query has no k-th best
            return self.reach * np.maximum(proj.longest**2 + q_sq[rows] - 2 * floor[rows], 0) + 1e-9

        def gaps(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Squared projected distance of queries to boxes."""
            out = np.zeros((len(rows), len(low)))
            for a in range(p.shape[1]):
                x = pq[rows, a, None]
                out += np.maximum(0, np.maximum(low[None, :, a] - x, x - high[None, :, a])) ** 2
            return out

        live = np.arange(len(q))
        live = live[gaps(live, p.min(axis=0)[None], p.max(axis=0)[None])[:, 0] < limit(live)]
        starts = np.arange(0, len(c), leaf)
        low, high = np.minimum.reduceat(p, starts, axis=0), np.maximum.reduceat(p, starts, axis=0)
        qs, cs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in range(0, len(live), QUERIES):
            some = live[at:at + QUERIES]
            leaves = (gaps(some, low, high) < limit(some)[:, None]).any(axis=0)
            rows = np.flatnonzero(np.repeat(leaves, leaf)[:len(c)])
            cc, cc_ids = c[rows], c_ids[rows]
            apart = pq_sq[some, None] + p_sq[None, rows] - 2 * (pq[some] @ p[rows].T)
            for i, near in zip(some, apart):
                other = cc_ids != q_ids[i]
                if np.isinf(floor[i]) and other.sum() > k:
                    first = np.flatnonzero(other)
                    if len(first) > FIRST * k:
                        first = first[np.argpartition(near[first], FIRST * k)[:FIRST * k]]
                    floor[i] = np.partition(cc[first] @ q[i], -k)[-k]
                    floor[i] -= 1e-9 * (1 + abs(floor[i]))
                    self.scored += len(first)
                j = np.flatnonzero((near < limit(i)) & other)
                self.scored += len(j)
                score = cc[j] @ q[i]
                if len(j) > k:
                    best = np.partition(score, -k)[-k]
                    keep = score >= max(floor[i], best) - 1e-9 * (1 + abs(best))
                else:
                    keep = score >= floor[i] - 1e-9 * (1 + np.abs(score))
                qs.append(np.full(keep.sum(), i))
                cs.append(rows[j[keep]])
                ss.append(score[keep])
        qi, ci, score = np.concatenate(qs), np.concatenate(cs), np.concatenate(ss)
        # the correctly rounded sum, whatever order a library adds in
        score = np.array([math.fsum((q[i] * c[j]).tolist()) for i, j in zip(qi, ci)], np.float64)
        best = B.best_rows(qi, score, c_ids[ci], k)
        return qi[best], ci[best], score[best]


ASKED = "query_id long, vec binary, own long, floor double, vec_ids array<long>, scores array<double>"
GROUP = "dim int, ids binary, vecs binary, owns binary, floors binary"


def ask_own(blocks: DataFrame, proj: Projection, k: int, every: int, confidence: float) -> DataFrame:
    """Every query with what it finds in its own block and the floor that this sets."""
    shared = blocks.sparkSession.sparkContext.broadcast(proj)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(shared.value, k, confidence)
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                ids, held = B.unpack(b["dim"], b["ids"], b["vecs"])
                asks = np.flatnonzero(ids % every == 0)
                if not len(asks):
                    continue
                qi, ci, score = search.block(ids[asks], held[asks], ids, held, np.full(len(asks), -np.inf))
                ends = np.concatenate([[0], np.cumsum(np.bincount(qi, minlength=len(asks)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[asks]), pa.array([held[a].tobytes() for a in asks], pa.binary()), pa.array(np.full(len(asks), b["block"])),
                    pa.array(B.floors(qi, score, len(asks), k)), pa.ListArray.from_arrays(ends, pa.array(ids[ci])), pa.ListArray.from_arrays(ends, pa.array(score))],
                    names=["query_id", "vec", "own", "floor", "vec_ids", "scores"])

    return blocks.mapInArrow(run, ASKED)


def grouped(asked: DataFrame, count: int) -> DataFrame:
    """Groups of queries of one cell or neighbouring ones, a row a group. Partitions follow the
    cells, so they are joined as they are, into full groups as far as possible."""
    placed = asked.select("query_id", "vec", "own", "floor").coalesce(max(1, count // (4 * QUERIES))).sortWithinPartitions("own", "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                ids, vecs, owns, floors = batch.slice(start, QUERIES).columns
                held = B.matrix(vecs.to_pylist())
                packed = [x.to_numpy().tobytes() for x in (ids, owns, floors)]
                yield pa.RecordBatch.from_arrays([pa.array([held.shape[1]], pa.int32()), *[pa.array([x], pa.binary()) for x in (packed[0], held.tobytes(), *packed[1:])]],
                                                 names=["dim", "ids", "vecs", "owns", "floors"])

    return placed.mapInArrow(run, GROUP)


def ask_others(groups: DataFrame, blocks: DataFrame, proj: Projection, k: int, confidence: float) -> DataFrame:
    """(query_id, vec_id, score) of what queries find outside their own block. Groups of queries
    are dealt to slots, each copy meeting the blocks of its slot one at a time."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(proj)
    slots = min(SLOTS, max(B.LEAST_SLOTS, blocks.count() // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(shared.value, k, confidence)
        for batch in batches:
            for i in range(batch.num_rows):
                g = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = B.unpack(g["q_dim"], g["q_ids"], g["q_vecs"])
                owns, floor = np.frombuffer(g["owns"], np.int64), np.frombuffer(g["floors"], np.float64)
                others = np.flatnonzero(owns != g["block"])
                if not len(others):
                    continue
                c_ids, c = B.unpack(g["dim"], g["ids"], g["vecs"])
                qi, ci, score = search.block(q_ids[others], q[others], c_ids, c, floor[others])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[others][qi]), pa.array(c_ids[ci]), pa.array(score)], names=["query_id", "vec_id", "score"])

    dealt = groups.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "owns", "floors",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    met = dealt.join(blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))), "slot")
    return met.select("q_dim", "q_ids", "q_vecs", "owns", "floors", "block", "dim", "ids", "vecs").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, up to
    ``k`` of the rows of largest inner product among all others, ties to the smaller id.

    Scores are exact on the original vectors, in double precision. Rows with a null id or
    vector, a zero or empty vector, or a null or non-finite component take no part; a
    shorter vector counts as ending in zeros. Every row is indexed. A query with fewer
    candidates gets all of them. A row repeated as it is counts once.
    """
    vectors = B.clean(table, id_col, vec_col, integers=False, zero=False)
    size = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("queries"), F.max("length").alias("m"),
                       F.max(F.length("vec") / 8).alias("dim")).first()
    if not size["n"]:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    proj = Projection(int(size["dim"]), size["m"])
    sample = hash_sample(vectors, "vec_id", SAMPLE, size["n"]).collect()
    levels = min(9, max(0, math.ceil(math.log2(size["n"] / B.BLOCK_ROWS))))
    tree = UpperTree(proj.vectors(B.matrix([r["vec"] for r in sample], proj.dim)), levels)
    n = max(1, -(-size["n"] // B.BLOCK_ROWS))
    # the hash of the id cuts a cell that holds more than its share
    order = ("cell", F.xxhash64("vec_id"), "vec_id", "vec")
    placed = in_cells(vectors, proj, tree).repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = checkpointed(B.pack(placed, B.BLOCK_ROWS, lambda held: kd_order(proj.split(held)[1])))
    asked = checkpointed(ask_own(blocks, proj, k, every, confidence))
    own = asked.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("hit")).select("query_id", F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    groups = checkpointed(grouped(asked, size["queries"]))
    return B.ranked(own.union(ask_others(groups, blocks, proj, k, confidence)), k)
