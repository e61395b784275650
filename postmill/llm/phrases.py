"""Phrase collocation mining by best-first branch and bound (operator 12).

A phrase grows word by word from its prefix. With f for counts, a phrase w1 w2 w3 scores
the lower of its two cuts, f(w1 w2 w3)^2 / (f(w1) f(w2 w3)) and
f(w1 w2 w3)^2 / (f(w1 w2) f(w3)). As a phrase is no more frequent than its parts, the
first cut is at most f(w1 w2) / f(w1), which the counts of the prefix tell, and the second
at most f(w2 w3) / f(w3): bounds that never fall short of a score. A pair's own bound from
its first word alone is 1, so pairs of frequent words are all counted.

1. Words are counted by language, then pairs of frequent words: first 64-bit hashes of
   pairs alone, which are small rows, then the pairs whose hash reaches ``least``, by their
   words. Two pairs of one hash only let a rare pair into the second count.
2. Each language's frontier is cut at a threshold (score, frequency): that of its pair of
   rank ``top``. Prefixes whose bound reaches it are expanded, and pairs whose own score
   reaches it are grown on both sides, to see which of them a longer phrase replaces. Only
   those triples are counted, and a counted triple is counted everywhere.
3. Every phrase over the threshold is now known, so a language with ``top`` survivors over
   it is settled, ties included. The others go on with a threshold of a rank four times
   as deep; one whose pairs run out is expanded whole.

Each step is a pass over the texts in which a slice is parsed and counted as arrays; the
counts meet in partial aggregates. What a pass must know of the tables of words and pairs
goes with it as a sketch of fixed size: flags in 2^23 buckets by hash. Two keys in one
bucket share their flags, so a sketch admits too much at times and never too little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from postmill.llm.common import Scratch, give_back, slices
from postmill.llm.linededup import mix

TOP, LEAST, LONGER_PERCENT = 2000, 10, 50
SCALE = 1_000_000
DEEPER = 4
BUCKETS, SEGMENT = 1 << 23, 1 << 16
SLICE = 2_000_000
WORD, BLANK, BREAK = 0, 1, 2
#: What a bucket says of its keys: frequent, a prefix to expand, a suffix of a phrase that
#: may reach the threshold, over the threshold itself.
FREQUENT, PREFIX, SUFFIX, CONTENDER = 1, 2, 4, 8

KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = BREAK
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


# ---- parsing a slice of texts -------------------------------------------------

class Parsed:
    """The words of a slice: codes of language and word, and whether the next word follows in its piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, ends, held = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(held or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        kind = KIND[data]
        inside = kind == WORD
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets] = True
        starts = np.flatnonzero(inside & ~(np.r_[False, inside[:-1]][:len(inside)] & ~opens[:-1]))
        stops = np.flatnonzero(inside & ~(np.r_[inside[1:], False][:len(inside)] & ~opens[1:])) + 1
        doc = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(kind == BREAK, dtype=np.int32)[starts] if len(starts) else starts
        self.follows = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        letters = FOLD[data[inside]]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]

    def hashes(self) -> np.ndarray:
        """A hash of (language, word) for each word."""
        return word_hashes(self.langs, self.words, self.lang, self.word)

    def counted(self, at: np.ndarray, size: int) -> pa.RecordBatch:
        """(lang, w1.., c) of the phrases of ``size`` words that begin at the positions ``at``."""
        v, key = len(self.words), self.lang[at] * len(self.words) + self.word[at]
        for k in range(1, size):
            if k > 1:  # keys become ranks, so products stay in 64 bits
                kept, key = np.unique(key, return_inverse=True)
            key = key * v + self.word[at + k]
        _, first, c = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        columns = [self.langs.take(pa.array(self.lang[at])), *[self.words.take(pa.array(self.word[at + k])) for k in range(size)]]
        return pa.RecordBatch.from_arrays([*[x.cast(pa.string()) for x in columns], pa.array(c, pa.int64())],
                                          names=["lang", *[f"w{k + 1}" for k in range(size)], "c"])


def word_hashes(langs: pa.Array, words: pa.Array, lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    of_lang = mix(np.array([xxhash.xxh64_intdigest(x) for x in langs.to_pylist()], np.uint64))
    of_word = np.array([xxhash.xxh64_intdigest(x) for x in words.to_pylist()], np.uint64)
    return mix(of_word[word] ^ of_lang[lang]) if len(word) else np.zeros(0, np.uint64)


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two words in order."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


# ---- passes over the texts ----------------------------------------------------

def over_slices(docs: DataFrame, chosen: Callable[[Parsed], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``chosen`` yields for each slice of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in slices(batch.column(1), SLICE):
                yield from chosen(Parsed(batch.column(0).slice(start, length), batch.column(1).slice(start, length)))
        give_back()

    return docs.select("lang", "text").mapInArrow(run, schema)


def count_pass(docs: DataFrame, size: int, chosen: Callable[[Parsed], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(lang, w1.., f) summed over what ``chosen`` yields for each slice of texts."""
    names = [f"w{k + 1}" for k in range(size)]
    counted = over_slices(docs, chosen, f"lang string, {', '.join(f'{n} string' for n in names)}, c long")
    return counted.groupBy("lang", *names).agg(F.sum("c").alias("f"))


def count_words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, w1, f) of words that reach ``least``; a null word holds the language's total."""

    def chosen(p: Parsed) -> Iterator[pa.RecordBatch]:
        yield p.counted(np.arange(len(p.word)), 1)
        totals = np.bincount(p.lang, minlength=len(p.langs))
        yield pa.RecordBatch.from_arrays([p.langs.cast(pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals, pa.int64())], names=["lang", "w1", "c"])

    return count_pass(docs, 1, chosen).filter((F.col("f") >= least) | F.col("w1").isNull())


def count_pair_hashes(docs: DataFrame, least: int, words) -> DataFrame:
    """(bucket, flags) of the hashes of pairs of frequent words that reach ``least``."""

    def chosen(p: Parsed) -> Iterator[pa.RecordBatch]:
        h = p.hashes()
        frequent = words.value[buckets(h)] > 0
        at = np.flatnonzero(p.follows & frequent[:-1] & frequent[1:])
        key, c = np.unique(chained(h[at], h[at + 1]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c, pa.int64())], names=["hash", "c"])

    def to_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = buckets(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), FREQUENT, np.int32))], names=["bucket", "flags"])

    counted = over_slices(docs, chosen, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("f"))
    return counted.filter(F.col("f") >= least).select("hash").mapInArrow(to_bucket, "bucket long, flags int")


def count_pairs(docs: DataFrame, least: int, hashes) -> DataFrame:
    """(lang, w1, w2, f) of pairs that reach ``least``; their hashes do."""

    def chosen(p: Parsed) -> Iterator[pa.RecordBatch]:
        h = p.hashes()
        yield p.counted(np.flatnonzero(p.follows & (hashes.value[buckets(chained(h[:-1], h[1:]))] > 0)), 2)

    return count_pass(docs, 2, chosen).filter(F.col("f") >= least)


def count_triples(docs: DataFrame, least: int, pairs) -> DataFrame:
    """(lang, w1, w2, w3, f) of the triples that the flags of their pairs admit and that reach ``least``."""

    def chosen(p: Parsed) -> Iterator[pa.RecordBatch]:
        h = p.hashes()
        flags = np.where(p.follows, pairs.value[buckets(chained(h[:-1], h[1:]))], 0)
        left, right = flags[:-1], flags[1:]
        expand = (left & PREFIX > 0) & (right & SUFFIX > 0)
        grown = (left & right & FREQUENT > 0) & ((left | right) & CONTENDER > 0)
        yield p.counted(np.flatnonzero(expand | grown), 3)

    return count_pass(docs, 3, chosen).filter(F.col("f") >= least)


def sketch(bucketed: DataFrame) -> np.ndarray:
    """Flags by bucket for rows (bucket, flags): ``BUCKETS`` bytes whatever the table's size."""

    def to_bytes(table: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT, np.uint8)
        out[table.column("bucket").to_numpy() % SEGMENT] = table.column("flags").to_numpy()
        return pa.table({"segment": table.column("segment").slice(0, 1), "held": pa.array([out.tobytes()], pa.binary())})

    merged = bucketed.groupBy("bucket").agg(F.bit_or("flags").alias("flags"))
    rows = merged.withColumn("segment", F.expr(f"bucket div {SEGMENT}")).groupBy("segment").applyInArrow(to_bytes, "segment long, held binary")
    out = np.zeros(BUCKETS, np.uint8)
    for r in rows.collect():  # at most BUCKETS / SEGMENT rows of SEGMENT bytes
        out[r["segment"] * SEGMENT:(r["segment"] + 1) * SEGMENT] = np.frombuffer(r["held"], np.uint8)
    return out


def in_buckets(keys: DataFrame, names: list[str]) -> DataFrame:
    """(bucket, flags) of rows (lang, names.., flags)."""

    def to_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.arange(b.num_rows)
            h = [word_hashes(b.column(0), b.column(1 + k), every, every) for k in range(len(names))]
            at = buckets(h[0] if len(h) == 1 else chained(*h))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1 + len(names))], names=["bucket", "flags"])

    return keys.select("lang", *names, "flags").mapInArrow(to_bucket, "bucket long, flags int")


# ---- scores and the search ----------------------------------------------------

def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a^2 / (left right)), exact in 38 digits."""
    return F.expr(f"(CAST({SCALE} AS DECIMAL(7, 0)) * CAST({a} AS DECIMAL(19, 0)) * CAST({a} AS DECIMAL(19, 0)))"
                  f" div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))")


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1, w2, a, l, r, score)."""
    left, right = (words.select("lang", F.col("w1").alias(w), F.col("f").alias(f)) for w, f in (("w1", "l"), ("w2", "r")))
    return pairs.join(left, ["lang", "w1"]).join(right, ["lang", "w2"]).select(
        "lang", "w1", "w2", F.col("f").alias("a"), "l", "r", score("f", "l", "r").alias("score"))


def scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) by the cut of lowest score, the first of equal ones."""
    def of(table: DataFrame, f: str, name: str, *ws: str) -> DataFrame:
        return table.select("lang", *[F.col(f"w{k + 1}").alias(w) for k, w in enumerate(ws)], F.col(f).alias(name))

    held = (triples.join(of(words, "f", "f1", "w1"), ["lang", "w1"]).join(of(words, "f", "f3", "w3"), ["lang", "w3"])
            .join(of(pairs, "a", "f12", "w1", "w2"), ["lang", "w1", "w2"]).join(of(pairs, "a", "f23", "w2", "w3"), ["lang", "w2", "w3"]))
    held = held.withColumn("s1", score("f", "f1", "f23")).withColumn("s2", score("f", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    return held.select("lang", "w1", "w2", "w3", F.col("f").alias("a"), F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                       F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))


def reaches(bound: Column, a: Column) -> Column:
    """(bound, a) is not below the threshold (t, t_a)."""
    return (bound > F.col("t")) | ((bound == F.col("t")) & (a >= F.col("t_a")))


def thresholds(pairs: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
    """(lang, t, t_a): score and frequency of the pair of that rank, 0 where there are fewer."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "w1", "w2")
    at = pairs.select("lang", "score", "a", "w1", "w2").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rank).filter(F.col("k") == rank)
    return langs.join(at.select("lang", F.col("score").alias("t"), F.col("a").alias("t_a")), "lang", "left").na.fill(0, ["t", "t_a"])


def survivors(pairs: DataFrame, triples: DataFrame, limits: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases over the threshold that no longer one replaces."""
    longest = (triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a"))
               .groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer")))
    over = pairs.join(limits, "lang").filter(reaches(F.col("score"), F.col("a"))).join(longest, ["lang", "w1", "w2"], "left")
    kept = over.filter(F.col("longer").isNull() | (100 * F.col("longer") < LONGER_PERCENT * F.col("a")))
    whole = triples.join(limits, "lang").filter(reaches(F.col("score"), F.col("a")))
    return (kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
            .union(whole.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST) -> DataFrame:
    """The first ``top`` phrases of two or three words of each language: lang, rank (from 1),
    phrase, a, l, r, n, score, by score and frequency descending, then phrase in byte order.

    A-Z are lower-cased, pieces end at `.,;:!?` and line ends, words at blank and tab. A
    candidate occurs ``least`` times; a is its frequency, l and r those of the parts of its
    lowest cut, n the language's words. A candidate contained in a longer candidate of half
    its frequency or more goes. Null and empty texts have no words, a null language is
    ``und``; repeated rows each count; no other column is read. A language without
    candidates, or an empty table, gives no rows.
    """
    spark = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark)
    docs = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    counted = scratch.table(count_words(docs, least))
    totals, words = counted.filter("w1 IS NULL").select("lang", F.col("f").alias("n")), counted.filter("w1 IS NOT NULL")
    known = sc.broadcast(sketch(in_buckets(words.withColumn("flags", F.lit(FREQUENT)), ["w1"])))
    hashes = sc.broadcast(sketch(count_pair_hashes(docs, least, known)))
    pairs = scratch.table(scored_pairs(count_pairs(docs, least, hashes), words))
    open_langs, rank, settled = scratch.table(pairs.select("lang").distinct()), top, []
    while not open_langs.isEmpty():
        limits = scratch.table(thresholds(pairs, open_langs, rank))
        flagged = pairs.join(limits, "lang").withColumn("flags", F.lit(FREQUENT) + sum((
            F.when(reaches(bound, F.col("a")), flag).otherwise(0) for bound, flag in (
                (F.expr(f"{SCALE} * a div l"), PREFIX), (F.expr(f"{SCALE} * a div r"), SUFFIX), (F.col("score"), CONTENDER))), F.lit(0)))
        frontier = sc.broadcast(sketch(in_buckets(flagged, ["w1", "w2"])))
        # one row a language; only open ones are read again
        triples = count_triples(docs.join(limits.select("lang"), "lang", "left_semi"), least, frontier)
        triples = scratch.table(scored_triples(triples, pairs, words))
        found = scratch.table(survivors(pairs, triples, limits))
        sizes = limits.join(found.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
        state = scratch.table(sizes.select("lang", ((F.col("t_a") == 0) | (F.coalesce("found", F.lit(0)) >= top)).alias("settled")))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        first = (found.join(state.filter("settled"), "lang", "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
        settled.append(scratch.table(first))
        open_langs, rank = scratch.table(state.filter("NOT settled").select("lang")), rank * DEEPER
    out = settled[0] if settled else scratch.table(spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long, rank int"))
    for more in settled[1:]:
        out = out.union(more)
    scratch.clear(counted, *settled) if settled else scratch.clear(counted, out)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
