"""Exact top-k inner products over norm-sorted blocks (operator 4).

Vectors are range-partitioned and sorted by descending length. Candidates are taken in
that order in stripes; a query leaves a block once its length times the stripe's longest
vector is under its k-th best score. Within a stripe, vectors are rotated by the right
singular vectors of a sample, which moves most of the length into the first dimensions:
the partial sum over these plus the product of the residual lengths (Cauchy-Schwarz)
bounds the score. Partial sums grow by a quarter of the dimensions at a time; after each,
queries and vectors of which no pair can reach the floor leave the stripe, and only pairs
whose last bound reaches it are computed in full. The rotation is orthogonal, so it decides
how much is pruned, never what is found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from postmill.llm import vecblocks as B
from postmill.llm.common import checkpointed, hash_sample

SAMPLE = 4096   # vectors the rotation is fitted on, at most
STRIPE = 512
PARTS = 4       # of the rotated dimensions; all but the last form partial sums
EXACT = 2.0**52


def rotation(vectors: DataFrame, total: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, by falling singular value."""
    got = hash_sample(vectors, "vec_id", SAMPLE, total).collect()
    x = B.matrix([r["vec"] for r in got])
    if not x.size:
        return np.zeros((x.shape[1], x.shape[1]))
    return np.linalg.svd(x, full_matrices=True)[2].T if len(x) < x.shape[1] else np.linalg.eigh(x.T @ x)[1][:, ::-1]


def dots(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of row pairs; whole numbers beyond 2^52 by Python's integers, held to the long range."""
    if exact:
        return np.einsum("ij,ij->i", q, c)
    out = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, c)]
    return np.array([min(max(v, -2**63), 2**63 - 1) for v in out], object)


class Rotated:
    """Rotated vectors with the lengths of what is left after each part of the dimensions."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.x, self.length = x @ turn, np.sqrt((x * x).sum(axis=1))
        dim = x.shape[1]
        self.ends = sorted({max(1, dim * p // PARTS) for p in range(1, PARTS)} if dim else {0})
        square = np.cumsum(self.x * self.x, axis=1)
        self.rest = [np.sqrt(np.maximum(self.length**2 - (square[:, e - 1] if e else 0), 0)) + 1e-7 * self.length for e in self.ends]


def reaching(q: Rotated, rows: np.ndarray, c: Rotated, part: slice, floor: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in ``rows``, position in ``part``) whose score may reach the floor."""
    keep, cols = np.arange(len(rows)), np.arange(part.start, min(part.stop, len(c.x)))
    total, begin, can = np.zeros((len(keep), len(cols))), 0, None
    for end, q_rest, c_rest in zip(q.ends, q.rest, c.rest):
        at = rows[keep]
        total = total + q.x[at, begin:end] @ c.x[cols, begin:end].T
        can = total + np.outer(q_rest[at], c_rest[cols]) + slack[keep, None] >= floor[at, None]
        some_q, some_c = can.any(axis=1), can.any(axis=0)
        keep, cols, total, can = keep[some_q], cols[some_c], total[some_q][:, some_c], can[some_q][:, some_c]
        begin = end
        if not len(keep):
            break
    i, j = np.nonzero(can)
    return keep[i], cols[j]


class Comparison:
    """The block comparison for ``vecblocks.search``. ``scored`` counts pairs computed in full, ``met`` all."""

    def __init__(self, turn: np.ndarray, k: int):
        self.turn, self.k, self.scored, self.met = turn, k, 0, 0

    def __call__(self, q_ids, q, c_ids, c, floor):
        dim, k = max(q.shape[1], c.shape[1]), self.k
        q, c = B.fit_dim(q, dim), B.fit_dim(c, dim)
        v = self.turn if self.turn.shape[0] == dim else np.eye(dim)
        qr, cr = Rotated(q, v), Rotated(c, v)
        self.met += len(q) * len(c)
        exact = bool(qr.length.max(initial=0) * cr.length.max(initial=0) < EXACT)
        floor = floor.copy()
        bq, bc, bs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, float if exact else object)
        for at in range(0, len(c), STRIPE):
            slack = 1 + 1e-9 * qr.length * cr.length[at]  # for rounding in the bounds
            live = np.flatnonzero(qr.length * cr.length[at] + slack >= floor)
            if not len(live):
                break  # later vectors are no longer
            qi, ci = reaching(qr, live, cr, slice(at, at + STRIPE), floor, slack[live])
            qi = live[qi]
            other = q_ids[qi] != c_ids[ci]
            qi, ci = qi[other], ci[other]
            if not len(qi):
                continue
            self.scored += len(qi)
            if exact and len(qi) * 4 > len(live) * STRIPE:
                score = (q[live] @ c[at:at + STRIPE].T)[np.searchsorted(live, qi), ci - at]
            else:
                score = np.concatenate([dots(q[qi[i:i + 65536]], c[ci[i:i + 65536]], exact) for i in range(0, len(qi), 65536)])
            keep = score >= floor[qi]
            bq, bc, bs = np.concatenate([bq, qi[keep]]), np.concatenate([bc, ci[keep]]), np.concatenate([bs, score[keep]])
            best = B.best_rows(bq, bs, c_ids[bc], k)
            bq, bc, bs = bq[best], bc[best], bs[best]
            floor = np.maximum(floor, B.floors(bq, bs.astype(float), len(q_ids), k) if exact else np.nextafter(B.floors(bq, bs.astype(float), len(q_ids), k), -np.inf))
        return bq, bc, bs


def exact_top_k(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the
    ``k`` rows of largest integer inner product among all others, ties to the smaller id.

    Components are floor(256 x). Rows with a null id or vector, or a null or non-finite
    component, take no part; a zero or empty vector scores 0; a shorter vector counts as
    ending in zeros. A query with fewer candidates gets all of them. A row repeated as it
    is counts once; different vectors under one id each take part. Scores beyond the long
    range are held to it.
    """
    vectors = B.clean(table, id_col, vec_col, integers=True, zero=True)
    size = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    n = max(1, -(-size["n"] // B.BLOCK_ROWS))
    turn = rotation(vectors, size["n"])
    order = (F.desc("length"), "vec_id", "vec")
    blocks = checkpointed(B.pack(vectors.repartitionByRange(n, *order).sortWithinPartitions(*order), B.BLOCK_ROWS))
    queries = checkpointed(B.query_blocks(vectors, every, size["queries"]))
    head = B.pick(blocks, F.min("block"))
    if head is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = B.search(queries, blocks, head, Comparison(turn, k), k, "long")
    return B.ranked(hits, k)
