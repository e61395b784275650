"""Spelling variant grouping with partition-and-enumerate signatures (operator 13).

A word is a binary vector over (letter, occurrence): "banana" has a1 a2 a3 b1 n1 n2. One
replaced code point changes two of these at most, one inserted or deleted code point
exactly one, so near words have a Hamming distance of at most two.

1. Runs of letters are cut from the texts, given their deletion and counted with partial
   aggregates, all in built-in functions.
2. The dimensions are dealt to P parts by hash. Words of equal length differ in at most two
   of 5 parts, so of the 10 signatures that leave two parts out one is equal; words whose
   lengths differ by one differ in one of 4 parts. A signature is a hash of the length, the
   parts left out and the rest of the vector.
3. Words that share a signature meet in an equi-join whose condition is the exact edit
   distance, so only true pairs leave it; no group is gathered. Tasks are counted by the
   signatures, since comparing costs more than the rows' bytes tell.
4. A word's form is its most frequent near word; forms are followed to the last by pointer
   doubling. Each step multiplies the frequency by ten, so a chain is short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from postmill.llm.common import Scratch
from postmill.llm.linededup import LOWER, UPPER, mix

LETTERS = "[A-Za-zÀ-ÿ]+"
DROP_EVERY = 31
LEAST_CHARS, LEAST_COUNT, FORM_RATIO = 7, 2, 10
SAME_PARTS, CROSS_PARTS = 5, 4
SIGNATURES_PER_TASK = 100_000
BATCH = 50_000


def letter_runs(text: Column) -> Column:
    """Maximal runs of letters, A-Z lower-cased; none in a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(LETTERS), F.lit(0))


def without_dropped(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where 31 divides the crc32 of `<doc_id>:<run>` (a null id is empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DROP_EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, text_col: str, id_col: str, least_chars: int, least_count: int) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    runs = docs.select(docs[id_col].alias("id"), F.explode(letter_runs(docs[text_col])).alias("run"))
    long_runs = runs.filter(F.char_length("run") >= least_chars)  # a deletion only shortens
    words = long_runs.select(without_dropped(F.col("id"), F.col("run")).alias("word")).filter(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# ---- signatures -----------------------------------------------------------------

def parts_of(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, lengths): for each word and part the sum of the hashes of its dimensions there."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, word))
    word, letters = word[order], letters[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (letters[1:] != letters[:-1])
    at = np.arange(len(word))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    dims = mix(mix(letters.astype(np.uint64)) + occurrence.astype(np.uint64))
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (word, (mix(dims) % np.uint64(parts)).astype(np.int64)), dims)
    return sums, lengths


def signed(sums: np.ndarray, left_out: int, lengths: np.ndarray) -> np.ndarray:
    """A row of signatures a word, one for each choice of parts left out."""
    total, out = sums.sum(axis=1), []
    for k, gone in enumerate(combinations(range(sums.shape[1]), left_out)):
        rest = total - sum(sums[:, p] for p in gone)
        out.append(mix(mix(rest) ^ mix(lengths.astype(np.uint64) * np.uint64(64) + np.uint64(k))))
    return np.stack(out, axis=1).view(np.int64)


def signatures(words: DataFrame, kind: str) -> DataFrame:
    """(key, word, n), a row a signature: ``same`` for words of equal length, ``longer`` and
    ``shorter`` for the two sides of words whose lengths differ by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                sums, lengths = parts_of(batch.column(0), SAME_PARTS if kind == "same" else CROSS_PARTS)
                keys = signed(sums, 2 if kind == "same" else 1, lengths + (kind == "shorter"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["word", "n", "keys"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, keys array<long>").select(F.explode("keys").alias("key"), "word", "n")


def near_pairs(words: DataFrame, tasks: int) -> DataFrame:
    """(word, near, near_n) for all pairs of words at an edit distance of one, both ways, each once."""

    def side(kind: str, name: str) -> DataFrame:
        # dealt to as many tasks as asked: AQE would merge them by their few bytes
        dealt = signatures(words, kind).repartition(tasks, "key")
        return dealt.withColumnsRenamed({"word": f"{name}_word", "n": f"{name}_n"})

    near = F.levenshtein("a_word", "b_word", 1) == 1
    a, b = side("same", "a"), side("same", "b").withColumnRenamed("key", "b_key")
    same = a.hint("merge").join(b, (F.col("key") == F.col("b_key")) & (F.col("a_word") < F.col("b_word")) & near)
    a, b = side("shorter", "a"), side("longer", "b").withColumnRenamed("key", "b_key")
    cross = a.hint("merge").join(b, (F.col("key") == F.col("b_key")) & near)
    found = same.select("a_word", "a_n", "b_word", "b_n").union(cross.select("a_word", "a_n", "b_word", "b_n")).distinct()
    both = F.explode(F.array(F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n"))))
    return found.select(both.alias("p")).select("p.*")


# ---- forms and roots --------------------------------------------------------------

def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = scratch.table(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = scratch.table(stepped.drop("moved"))
        if stepped.filter("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS,
                   least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words are runs of letters of ``least_chars`` code points or more found ``least_count``
    times over all texts. ``form`` is the near word of largest n (ties: the smallest) if
    that is ``ratio`` times the word's own or more, else null; ``root`` is the last of the
    forms, the word itself without one. Null and empty texts have no words, a null id counts
    as an empty one in the deletion rule, repeated rows each count; no other column is read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    shuffled = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = scratch.table(count_words(docs, text_col, id_col, least_chars, least_count).repartition(shuffled, "word"))
    keys = words.count() * (SAME_PARTS * (SAME_PARTS - 1) // 2 + 2 * CROSS_PARTS)
    pairs = scratch.table(near_pairs(words, max(shuffled, -(-keys // SIGNATURES_PER_TASK))))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    judged = words.join(best, "word", "left").withColumn("has_form", F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False)))
    judged = scratch.table(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                         F.when(F.col("has_form"), F.col("best.w")).alias("form"), F.when(F.col("has_form"), -F.col("best.m")).alias("form_n")))
    last = roots(judged.filter("form IS NOT NULL"), scratch)
    scratch.clear(judged, last)
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
