"""Language identification by rank-order n-gram profiles (operator 1).

A profile is the list of a language's most frequent letter n-grams in order. A document
is ranked the same way and compared with every profile by its out-of-place distance:
the sum over the document's n-grams of how far each lies from its place in the profile,
an absent one costing the whole profile length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from postmill.llm.common import slices

PROFILE = 400     # n-grams of a profile
BUCKETS = 32      # of the first of two top-k steps, so that no task ranks a whole language
UNKNOWN = "und"
BLANK = 32
BITS = 21         # of a code point in a packed n-gram

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter n-grams (n = 1, 2, 3) of a text in order, and their counts.

    Letters are lower-cased; everything else is one blank between words and at both
    ends. N-grams lie inside a word with its two blanks; the lone blank is none. An
    n-gram is its code points, BITS each, in one integer: shorter ones come first.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.concatenate([[BLANK], np.where(letters()[codes], codes, BLANK), [BLANK]])
    blank = codes == BLANK
    s = codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = s[:-1] << BITS | s[1:]
    three = (two[:-1] << BITS | s[2:])[s[1:-1] != BLANK]
    every = np.sort(np.concatenate([s[s != BLANK], two, three]))
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
    return every[at[:-1]], np.diff(at)


def ranked(text: str, k: int) -> np.ndarray:
    """The k most frequent n-grams of a text, ties in their order."""
    keys, counts = grams(text)
    return keys[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Ranks of every profile n-gram in every language, and the distance of texts to them."""

    def __init__(self, by_lang: dict[str, list[int]], k: int = PROFILE):
        self.langs, self.k = sorted(by_lang), k
        self.keys = np.array(sorted({g for p in by_lang.values() for g in p}) + [2**63 - 1], np.int64)
        self.rank = np.full((len(self.keys), len(self.langs)), -1, np.int64)
        for col, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, by_lang[lang]), col] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.k) if text and self.langs else ()
        if not len(own):
            return UNKNOWN, 0.0
        row = np.searchsorted(self.keys, own)
        places = np.where((self.keys[row] == own)[:, None], self.rank[row], -1)
        far = np.where(places < 0, self.k, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (self.k * len(own))


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", k: int = PROFILE) -> Profiles:
    """Profiles of every non-null language value from all given documents.

    Counts combine by batch, then by partial aggregates; the driver gets k n-grams for
    each language value.
    """
    src = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in slices(batch.column(1)):
                part = batch.slice(start, size)
                texts: dict[str, list[str]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    keys, counts = grams("\n".join(own))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))],
                                                     names=["lang", "gram", "n"])

    counts = src.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "bucket").orderBy(F.desc("n"), "gram")
    top = (counts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS))).withColumn("place", F.row_number().over(first))
           .filter(f"place <= {k}").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
           .filter(f"place <= {k}").select("lang", "gram", "place"))
    by_lang: dict[str, list] = {}
    for r in top.collect():
        by_lang.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return Profiles({lang: [g for _, g in sorted(p)] for lang, p in by_lang.items()}, k)


def predict_langs(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (1 less the distance's share of the largest one).

    Whole texts. A null text, one without a letter, or no learned language gives
    ``und`` and 0. Equal distances go to the first language value in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    src = docs.select(*keep, docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType(), False),
                           T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = shared.value, len(keep)
        for batch in batches:
            for start, size in slices(batch.column(n)):
                part = batch.slice(start, size)
                got = [model.predict(t) for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([x for x, _ in got], pa.string()),
                                                  pa.array([x for _, x in got], pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)


def crc_fold(id_col: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))
