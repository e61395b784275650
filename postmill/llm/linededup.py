"""Corpus-wide line dedup over a sharded minimal perfect hash (operator 2).

1. The distinct line keys of each document are hashed (2 x 64 bits) and counted over
   all documents with a partial aggregate, so a hot line is combined before the shuffle.
2. Keys found in two documents or more are dealt to shards by hash. Each shard is a
   minimal perfect hash (levels of bit arrays; a key sits at the first level where it
   collides with none) over an array of fingerprints and an array of counts, packed
   into one row.
3. Documents send only hashes to the shards and probe the arrays; a line that no slot
   vouches for has a fingerprint that differs. Keys that hold over 1/HEAVY_KEYS of all
   counts are fewer than HEAVY_KEYS by construction, so they are broadcast and their
   probes spread over all tasks instead of meeting in one shard. A shard whose other keys
   are met more than SHARD_PROBES times is met in as many copies, each with its share of
   the documents, so no task's probes grow with the corpus.
4. Dropped lines travel back as positions in the document's list of distinct keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql import types as T

from postmill.llm.common import HEAVY_KEYS, checkpointed, doc_key, join_on_doc_key

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
SHARD_KEYS, SHARD_PROBES, LEAST_SHARDS = 32_768, 131_072, 256
SLOTS = 65_536    # classes of shards that have a number of copies each
LEVEL_ROOM = 2.0  # bits of a level for each key still without a slot
SEED = 0x5EED


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of key hashes with a fingerprint and a count in each slot."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        self.before = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @staticmethod
    def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salted = h1 + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        return (mix(mix(salted) ^ h2) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """Keys must be distinct pairs (h1, h2)."""
        left, levels = np.arange(len(h1)), []
        while len(left):
            size = max(8, int(LEVEL_ROOM * len(left)))
            at = cls._places(h1[left], h2[left], len(levels), size)
            levels.append((np.bincount(at, minlength=size) == 1))
            left = left[~levels[-1][at]]
        out = cls([b.astype(np.int64) for b in levels], np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32))
        slot = out.slots(h1, h2)
        out.prints[slot] = h2
        out.counts[slot] = np.minimum(counts, 2**32 - 1)
        return out

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has the bit (then it is no key)."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            at = self._places(h1[left], h2[left], k, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Counts of the keys; 0 for what is not indexed."""
        slot = self.slots(h1, h2)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == h2[known]
        out = np.zeros(len(h1), np.int64)
        out[known] = self.counts[slot[known]]
        return out

    def pack(self) -> dict:
        return {"sizes": [len(b) for b in self.levels],
                "bits": np.packbits(np.concatenate([b.astype(np.uint8) for b in self.levels] or [np.zeros(0, np.uint8)])).tobytes(),
                "prints": self.prints.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def unpack(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes) -> PerfectHash:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8))[:sum(sizes)].astype(np.int64)
        return cls(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [],
                   np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32))


def line_keys(text: Column) -> Column:
    """The distinct keys of a text's lines, in order of first occurrence."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"),
                                        lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER)))


def hashed(keys: Column, least_chars: int) -> Column:
    """(h1, h2) of each key, null for keys that are too short to count."""
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= least_chars, F.struct(
        F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(SEED), k).alias("h2"))))


def count_lines(docs: DataFrame, text_col: str, least_chars: int) -> tuple[DataFrame, int]:
    """(h1, h2, n) of keys found in two documents or more; the number of (document, key) pairs."""
    seen = Observation("line_keys")
    pairs = docs.select(F.explode(hashed(line_keys(docs[text_col]), least_chars)).alias("h")).filter("h IS NOT NULL")
    counts = pairs.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n"))
    counts = checkpointed(counts.observe(seen, F.sum("n").alias("pairs")).filter("n >= 2"))
    return counts, seen.get.get("pairs") or 0


def build_index(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard: the packed minimal perfect hash with its fingerprints and counts."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        row = PerfectHash.build(h1, h2, table.column("n").to_numpy()).pack()
        return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), **row}], schema=pa.schema([
            ("shard", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary())]))

    return (counts.withColumn("shard", F.pmod("h1", F.lit(n_shards))).groupBy("shard")
            .applyInArrow(build, "shard long, sizes array<int>, bits binary, prints binary, counts binary"))


def shard_copies(counts: DataFrame, n_shards: int) -> DataFrame:
    """(slot, copies): how many copies the shards of a slot need, where that is over one; at
    most SLOTS rows. ``counts`` are those of the indexed keys."""
    loads = counts.groupBy(F.pmod("h1", F.lit(n_shards)).alias("shard")).agg(F.sum("n").alias("load"))
    most = loads.groupBy(F.pmod("shard", F.lit(SLOTS)).alias("slot")).agg(F.max("load").alias("load"))
    return checkpointed(most.select("slot", F.ceil(F.col("load") / SHARD_PROBES).cast("long").alias("copies")).filter("copies > 1"))


def dropped_keys(docs: DataFrame, text_col: str, id_col: str, min_docs: int, least_chars: int) -> DataFrame:
    """(k_id, k_text, dropped): for documents with a dropped line, the positions of the
    dropped keys in the document's list of distinct keys."""
    counts, pairs = count_lines(docs, text_col, least_chars)
    size = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    n_shards = max(LEAST_SHARDS, -(-size["keys"] // SHARD_KEYS), -(-pairs // SHARD_PROBES))
    # each holds over 1/HEAVY_KEYS of the total, so there are fewer than HEAVY_KEYS of them
    heavy = counts.filter(F.col("n") > F.lit(size["total"]) / HEAVY_KEYS)
    light = counts.filter(F.col("n") <= F.lit(size["total"]) / HEAVY_KEYS)
    copies = shard_copies(light, n_shards)

    def with_copies(df: DataFrame) -> DataFrame:
        """``df`` with the ``copies`` of its shard; the table has at most SLOTS rows."""
        joined = df.withColumn("slot", F.pmod("shard", F.lit(SLOTS))).join(F.broadcast(copies), "slot", "left")
        return joined.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))

    index = with_copies(build_index(light, n_shards)).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    index = index.select("shard", "copy", "sizes", "bits", "prints", "counts")

    probes = (docs.select(*doc_key(docs[id_col], docs[text_col]),
                          F.posexplode(hashed(line_keys(docs[text_col]), least_chars)).alias("k", "h"))
              .filter("h IS NOT NULL").select("k_id", "k_text", "k", "h.h1", "h.h2"))
    spread = -F.lit(1) - F.pmod(F.xxhash64("k_id", "k_text"), F.lit(n_shards))
    probes = (probes.join(F.broadcast(heavy), ["h1", "h2"], "left")
              .filter(f"n IS NULL OR n >= {min_docs}")
              .withColumn("shard", F.when(F.col("n").isNull(), F.pmod("h1", F.lit(n_shards))).otherwise(spread))
              .drop("n"))
    probes = with_copies(probes).withColumn("copy", F.when(F.col("shard") < 0, 0).otherwise(F.pmod(F.xxhash64("k_text", "k_id"), F.col("copies"))).cast("long"))
    probes = probes.select("k_id", "k_text", "k", "h1", "h2", "shard", "copy")

    def probe(lines: pa.Table, shard: pa.Table) -> pa.Table:
        out = lines.select(["k_id", "k_text", "k"])
        if lines.num_rows and lines.column("shard")[0].as_py() < 0:
            return out  # heavy keys, already known to be over the limit
        if not lines.num_rows or not shard.num_rows:
            return out.slice(0, 0)
        table = PerfectHash.unpack(*(shard.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts")))
        h1, h2 = (lines.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return out.filter(pa.array(table.lookup(h1, h2) >= min_docs))

    hits = probes.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInArrow(probe, "k_id long, k_text long, k int")
    return hits.groupBy("k_id", "k_text").agg(F.collect_set("k").alias("dropped"))


def keep_lines(text: str, dropped, least_rest: int | None = None) -> tuple[str, int]:
    """The text without the lines whose key has one of the given positions; how many went.

    With ``least_rest``, a text that would keep no key of so many code points stays whole."""
    gone, order, kept, rest = set(dropped), {}, [], least_rest is None
    lines = text.split("\n")
    for line in lines:
        key = line.strip(BLANKS).translate(FOLD)
        if order.setdefault(key, len(order)) not in gone:
            kept.append(line)
            rest = rest or len(key) >= least_rest
    return ("\n".join(kept), len(lines) - len(kept)) if rest else (text, 0)


def _keep(least_rest: int | None):
    @F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_dropped", T.LongType())]))
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, dropped in batches:
            yield pd.DataFrame([("", 0) if t is None else keep_lines(t, d, least_rest) for t, d in zip(texts, dropped)],
                               columns=["kept", "n_dropped"])

    return keep


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10,
                least_chars: int = 1, keep_whole: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` cleared of common lines, and
    ``line_n_lines``, ``line_n_dropped``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at
    least ``least_chars`` code points found in ``min_docs`` documents (rows) or more
    lose all their lines everywhere. Null and empty texts are one empty line; a text
    whose lines all go becomes empty, or with ``keep_whole`` a text that would keep no
    line that counts (one of ``least_chars``) stays as it is, so that no text leaves the
    table altogether. Repeated rows count as documents of their own.
    Nothing is capped: whole texts, all lines, all documents.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    docs = docs.drop("line_n_lines", "line_n_dropped")
    src = docs.withColumn(text_col, F.coalesce(docs[text_col].cast("string"), F.lit("")))
    hits = dropped_keys(src, text_col, id_col, min_docs, least_chars)
    rows = src.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key(src[id_col], src[text_col]))
    text = F.col("row")[text_col]
    # only texts that lose a line go through Python
    keep = _keep(least_chars if keep_whole else None)
    joined = join_on_doc_key(rows, hits, "left").withColumn("cut", keep(F.when(F.col("dropped").isNotNull(), text), "dropped"))
    lost = F.col("dropped").isNotNull()
    return joined.select(
        *[(F.when(lost, F.col("cut.kept")).otherwise(text) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        F.size(F.split(text, "\n")).cast("long").alias("line_n_lines"),
        F.when(lost, F.col("cut.n_dropped")).otherwise(F.lit(0).cast("long")).alias("line_n_dropped"))
