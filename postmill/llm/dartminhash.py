"""Near-duplicate classes by DartMinHash (operator 10).

A document is the weighted set of its five-word shingles, a shingle's weight being its
number of occurrences. Every shingle owns a fixed random process of darts over
weight x time. A document sees the darts below its own weight; each dart names one of
K coordinates, and the earliest dart of a coordinate is the document's sample there.
Two documents agree in a coordinate with probability equal to their weighted Jaccard
similarity, and a document of any weight needs about K log K darts, not K a shingle.

Samples are joined in bands. Exact copies, documents of one weighted set, are first
folded into one numbered node each, so an id that comes again with another text is
another document. Two nodes are linked if they share a band's bucket and are similar
enough; that rule holds at every size. Nodes that share buckets, directly or through
others, form a family, found from one link a node and bucket. A family of one block's size
is verified at once, by one matrix product. In a larger family every node is first compared
with the hubs of its buckets, which joins a group of near copies by as many links as it has
nodes. Only pairs of nodes that are still apart remain: groups and loose nodes are cut into
blocks by a hash, bounded in nodes and bytes, pairs of blocks that have a bucket in common
are made from the blocks' numbers, and then joined with the blocks. A pair of blocks is one
row, which gives back links that span what it found. So no pair of nodes is a row, no group
is in one task, and no pair that shares a bucket goes unchecked unless it is linked already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from postmill.llm.common import Scratch, give_back, slices
from postmill.llm.graph import components

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5   # a pair at 0.8 shares no band with probability (1 - 0.8^5)^20 = 0.0004
CACHE = 300_000
BLOCK = 256           # nodes of a block, on average
BLOCK_ITEMS = 1 << 19 # and 64-bit items of their sets
COLUMNS = 8192        # of the matrices multiplied at once
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + np.asarray(salt, np.uint64) * GOLD)


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from hash bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class Shingler:
    """Hashes of a text's word shingles; words are hashed once and kept."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def shingles(self, text: str) -> np.ndarray:
        """One 64-bit hash for each run of ``size`` words (lower case, word characters
        only); fewer words make one shingle, a text without words counts as a whole."""
        words, known = WORD.findall(text.lower()), self.known
        if not words:
            return np.array([xxhash.xxh64_intdigest(text.strip(), seed=1)], np.uint64)
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = max(1, len(h) - self.size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.size, len(h))):
            out = mix(out ^ salted(h[k:k + n], k + 1))
        return out


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k sample ids. ``doc`` says whose each (element, weight) is; each document has one at least.

    The weight axis is cut into cells [0, 1), [1, 2), [2, 4), ...; darts of a cell come
    at exponential gaps, so a document only looks as far ahead in time as it needs.
    """
    reach = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1  # cells that a weight reaches into
    at = np.repeat(np.arange(len(elements)), reach)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    area = np.where(cell > 0, 2.0 ** (cell - 1), 1.0)
    seed, owner, weight = salted(elements[at], cell + 1), doc[at], weights[at]
    total = np.bincount(doc, weights, n_docs)
    horizon = (k * np.log(k) + 3 * k) / total
    best = np.full(n_docs * k, np.inf)
    ids = np.zeros(n_docs * k, np.uint64)
    dart = salted(seed, 1)
    when, count = -np.log(unit(dart)) / area, np.ones(len(seed), np.int64)
    while True:
        live = np.flatnonzero(when < horizon[owner])
        while len(live):
            d = mix(dart[live] ^ GOLD)
            hit = low[live] + area[live] * unit(d) <= weight[live]
            x, dx = live[hit], mix(d[hit])
            spot = owner[x] * k + (dx % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, spot, when[x])
            won = best[spot] == when[x]
            ids[spot[won]] = dx[won]
            count[live] += 1
            dart[live] = salted(seed[live], count[live])
            when[live] -= np.log(unit(dart[live])) / area[live]
            live = live[when[live] < horizon[owner[live]]]
        short = np.isinf(best).reshape(n_docs, k).any(axis=1)
        if not short.any():
            return ids.reshape(n_docs, k)
        horizon[short] *= 2


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        out = mix(salted(out, r + 1) ^ sig[:, r::rows][:, :bands])
    return out


def node_id(id_col: Column, text_col: Column) -> Column:
    """The id, or for a null id a negative number made from the text."""
    return F.coalesce(id_col.cast("long"), -F.lit(1) - F.xxhash64(text_col).bitwiseAND(F.lit(2**62 - 1)))


def node_key(id_col: Column, text_col: Column) -> list[Column]:
    """(uid, k_text): a document's identity, as ids may repeat with other texts."""
    return [node_id(id_col, text_col).alias("uid"), F.xxhash64(text_col).alias("k_text")]


def sign(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(uid, k_text, c1, c2, size, bands) of every document with a text: c1, c2 identify the
    weighted set, size is its weight."""
    src = docs.filter(docs[text_col].isNotNull()).select(*node_key(docs[id_col], docs[text_col]), docs[text_col].cast("string").alias("t"))
    names = ["uid", "k_text", "c1", "c2", "size", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for start, size in slices(batch.column(2), 1_500_000):
                part = batch.slice(start, size)
                sets = [np.unique(shingler.shingles(t), return_counts=True) for t in part.column(2).to_pylist()]
                doc = np.repeat(np.arange(size), [len(e) for e, _ in sets])
                elements, counts = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
                weights = counts.astype(np.uint64)
                ends = np.cumsum([len(e) for e, _ in sets])[:-1]
                starts = np.concatenate([[0], ends])
                with np.errstate(over="ignore"):
                    c1, c2 = (np.add.reduceat(salted(elements, s) * mix(weights + np.uint64(s)), starts) for s in (101, 202))
                keys = band_keys(signatures(elements, counts.astype(np.float64), doc, size, BANDS * ROWS))
                flat = pa.array(keys.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                     pa.array(np.add.reduceat(counts, starts), pa.int64()),
                     pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat)], names=names)
        give_back()

    return src.mapInArrow(run, "uid long, k_text long, c1 long, c2 long, size long, bands array<long>")


def packed_sets(docs: DataFrame, nodes: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(node, items): the weighted set of each of ``nodes`` (node, uid, k_text) as sorted 64-bit items, the j-th occurrence
    of a shingle being an item of its own; the Jaccard similarity of such sets is the weighted one."""
    src = docs.filter(docs[text_col].isNotNull()).select(*node_key(docs[id_col], docs[text_col]), docs[text_col].cast("string").alias("t"))
    # the nodes grow with the documents, so they are never broadcast
    src = src.join(nodes.hint("merge"), ["uid", "k_text"]).select("node", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for start, size in slices(batch.column(1), 1_500_000):
                part = batch.slice(start, size)
                out = []
                for t in part.column(1).to_pylist():
                    e, n = np.unique(shingler.shingles(t), return_counts=True)
                    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    out.append(np.sort(salted(np.repeat(e, n), turn)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.large_binary() if sum(map(len, out)) >= 2**31 else pa.binary())], names=["node", "items"])

    return src.mapInArrow(run, "node long, items binary").groupBy("node").agg(F.max("items").alias("items"))


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every set of ``y``.

    Only items found in two sets or more can be shared; these are the columns of two
    0/1 matrices whose product counts them.
    """
    items = np.concatenate([*x, *y])
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    new = np.concatenate([[True], items[1:] != items[:-1]]) if len(items) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    out = np.zeros((len(x), len(y)), np.float64)
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        m = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        out += m[:len(x)] @ m[len(x):].T
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (a, b) that join what the ones before them had not."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = x = top.get(top[x], top[x])
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            top[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


NODES = "array<struct<node:bigint,bands:array<bigint>,items:binary>>"


def block_links(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b): spanning links among the nodes of each pair of blocks (x, y), y null for a block
    with itself. Linked are nodes that share a band's key and are ``least`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = [batch.column(c)[i].as_py() for c in (0, 1)]
                x, y = (sorted(((r["node"], r["bands"], r["items"]) for r in b or ()), key=lambda r: r[0]) for b in blocks)
                keys, others = (np.array([bands for _, bands, _ in b], np.int64) for b in (x, y or x))
                shares = np.zeros((len(keys), len(others)), bool)
                for band in range(keys.shape[1]):
                    shares |= keys[:, band, None] == others[None, :, band]
                if not y:
                    shares = np.triu(shares, 1)
                if not shares.any():
                    continue
                xs, ys = ([np.frombuffer(items, np.uint64) for _, _, items in b] for b in (x, y or x))
                common = shared_counts(xs, ys)
                both = np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in ys])[None] - common
                a, b = np.nonzero(shares & (common >= least * both))
                at, other = np.array([r[0] for r in x]), np.array([r[0] for r in y or x])
                links = spanning(at[a], other[b])
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["a", "b"])
        give_back()

    return pairs.select("x", "y").mapInArrow(run, "a long, b long")


def pair_links(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of the rows (a, b, x, y) whose sets x and y are ``least`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def cut(nodes: DataFrame, group: list[str]) -> DataFrame:
    """``nodes`` (node, size, group...) with ``of``, the blocks of their group, and ``block``."""
    sizes = nodes.groupBy(*group).agg(F.count("*").alias("m"), F.sum("size").alias("items"))
    sizes = sizes.select(*group, F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).alias("of"))
    return nodes.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")))


def large_links(big: DataFrame, sets: DataFrame, members: DataFrame, links: DataFrame, least: float, scratch: Scratch) -> list[DataFrame]:
    """Links among the nodes ``big`` (node, family, size) of families of several blocks."""
    ours = sets.join(big.select("node"), "node", "left_semi").select("node", "bands", "items")
    x, y = (ours.select(F.col("node").alias(n), F.col("items").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    star = scratch.table(pair_links(links.join(x, "a").join(y, "b"), least))
    # nodes linked to the same hub are together; the least one is near enough to their component
    joined = star.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    group = scratch.table(big.join(joined, "node", "left").select("node", "family", "size", F.coalesce("label", "node").alias("group")))
    ours_in = members.select("key", "node").join(group.select("node", "group"), "node")
    mixed = ours_in.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low != high").select("key")
    left = scratch.table(ours_in.join(mixed, "key"))
    if left.isEmpty():
        return [star]
    apart = group.join(left.select("node").distinct(), "node")
    # nodes of a large group are apart from others only; those of small groups are loose and compared in their family
    many = apart.groupBy("group").agg(F.count("*").alias("m")).filter(F.col("m") >= BLOCK).select("group", F.lit(1).alias("tight"))
    apart = apart.join(many, "group", "left").select("node", "size", F.coalesce("tight", F.lit(0)).alias("kind"), F.when(F.col("tight") == 1, F.col("group")).otherwise(F.col("family")).alias("of_group"))
    blocks = scratch.table(cut(apart, ["kind", "of_group"]).select("node", F.struct("kind", "of_group", "block").alias("at")))
    packed = scratch.table(blocks.join(ours, "node").groupBy("at").agg(F.collect_list(F.struct("node", "bands", "items")).alias("x")))
    # pairs of blocks by their numbers: those of a bucket that reaches into both
    touched = scratch.table(left.select("key", "node").join(blocks, "node").select("key", "at").distinct())
    pairs = touched.join(touched.select("key", F.col("at").alias("with")), "key").filter("at < with")
    pairs = pairs.filter("NOT (at.kind = 1 AND with.kind = 1 AND at.of_group = with.of_group)").select("at", "with").distinct()
    alone = packed.filter("at.kind = 0").select("x", F.lit(None).cast(NODES).alias("y"))
    met = pairs.join(packed, "at").join(packed.select(F.col("at").alias("with"), F.col("x").alias("y")), "with").select("x", "y")
    return [star, scratch.table(block_links(alone.union(met), least))]


def near_links(nodes: DataFrame, docs: DataFrame, text_col: str, id_col: str, least: float, scratch: Scratch) -> DataFrame | None:
    """(node, label) of nodes that have a near copy among the distinct texts. ``nodes``: node, uid, k_text, size, bands."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = scratch.table(keys.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub")).filter("c > 1"))
    members = scratch.table(keys.join(shared.select("key", "hub"), "key"))
    if members.isEmpty():
        return None
    links = scratch.table(members.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    families = components(links, scratch).withColumnRenamed("label", "family").join(nodes.select("node", "size"), "node")
    placed = scratch.table(cut(families, ["family"]).select("node", "family", "size", "of"))
    found = packed_sets(docs, nodes.select("node", "uid", "k_text").join(placed.select("node"), "node"), text_col, id_col)
    sets = scratch.table(placed.join(found, "node").join(nodes.select("node", "bands"), "node").select("node", "family", "of", "bands", "items"))
    whole = sets.filter("of = 1").groupBy("family").agg(F.collect_list(F.struct("node", "bands", "items")).alias("x"))
    found = [scratch.table(block_links(whole.select("x", F.lit(None).cast(NODES).alias("y")), least))]
    big = placed.filter("of > 1").select("node", "family", "size")
    if not big.isEmpty():
        found += large_links(big, sets, members, links, least, scratch)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return components(every, scratch)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row a document: ``uid``, ``class_id``, ``exact_id``, ``k_text``, ``kept``.

    ``uid`` is the id (for a null id a negative number made from the text) and ``k_text``
    a hash of the text; an id that comes again with another text is another document.
    ``exact_id`` is the smallest uid among documents with the same weighted shingle set;
    ``class_id`` the smallest uid among all that are linked by a weighted Jaccard
    similarity of ``least`` or more, directly or through others. ``kept`` marks the
    document of the smallest (uid, k_text) of each class; where ids do not repeat, these
    are the rows with uid = class_id. Words are lower-cased runs of word characters; a
    text with fewer than five is one shingle; one without words (also the empty text)
    equals only the same text. A null text is in no class but its own. Rows that repeat
    both an id and its text share their row here.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.table(sign(docs, text_col, id_col))
    # bands and size are functions of the set
    nodes = scratch.table(signed.groupBy("c1", "c2").agg(F.min(F.struct("uid", "k_text")).alias("least"), F.count("*").alias("c"), F.first("size").alias("size"),
                                                            F.first("bands").alias("bands"))
                          .select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "c", "least.uid", "least.k_text", "size", "bands"))
    reps = nodes.filter("c > 1").select("c1", "c2", F.col("uid").alias("e_uid"), F.col("k_text").alias("e_text"))
    copies = scratch.table(signed.select("uid", "k_text", "c1", "c2").join(reps, ["c1", "c2"]).select("uid", "k_text", "e_uid", "e_text").distinct())
    labels = near_links(nodes, docs, text_col, id_col, least, scratch)
    linked = None
    if labels is not None:
        named = scratch.table(nodes.select("node", "uid", "k_text").join(labels, "node"))
        classes = named.groupBy("label").agg(F.min(F.struct("uid", "k_text")).alias("class"))
        linked = scratch.table(named.join(classes, "label").select(F.col("uid").alias("e_uid"), F.col("k_text").alias("e_text"), "class"))
    scratch.clear(*[t for t in (copies, linked) if t is not None])
    out = docs.select(*node_key(docs[id_col], docs[text_col])).join(copies, ["uid", "k_text"], "left")
    out = out.select("uid", "k_text", F.coalesce("e_uid", "uid").alias("e_uid"), F.coalesce("e_text", "k_text").alias("e_text"))
    top = F.struct(F.col("e_uid").alias("uid"), F.col("e_text").alias("k_text"))
    if linked is not None:
        out, top = out.join(linked, ["e_uid", "e_text"], "left"), F.coalesce("class", top)
    out = out.withColumn("top", top)
    return out.select("uid", F.col("top.uid").alias("class_id"), F.col("e_uid").alias("exact_id"), "k_text",
                      ((F.col("uid") == F.col("top.uid")) & (F.col("k_text") == F.col("top.k_text"))).alias("kept"))
