"""Corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; the caller writes it and reads it again for the next stage. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postmill.llm import bpe, dartminhash, linededup, pfair, quality
from postmill.llm.common import Scratch, doc_key, join_on_doc_key
from postmill.session import let_workers_import
from postmill.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    let_workers_import(spark)
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all texts; ``n_chars`` follows. Every
    document stays, and one made only of such lines stays whole: ten exact copies would
    all be emptied otherwise, where the next stage keeps one of them."""
    let_workers_import(spark)
    out = linededup.dedup_lines(docs.select(*COLUMNS), keep_whole=True).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies stays; a row repeated
    as it is stays once, and an id that comes again with another text is another document."""
    let_workers_import(spark)
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark)
    classes = dartminhash.near_duplicates(docs)
    gone = scratch.table(classes.filter("NOT kept").select(F.col("uid").alias("gone_uid"), F.col("k_text").alias("gone_text")).distinct())
    again = scratch.table(docs.select(*doc_key(docs["doc_id"], docs["text"])).groupBy("k_id", "k_text").count().filter("count > 1").drop("count"))
    scratch.clear(gone, again)
    keyed = docs.select("*", *doc_key(docs["doc_id"], docs["text"]), dartminhash.node_id(docs["doc_id"], docs["text"]).alias("uid"))
    # gone documents grow with the documents, so they are never broadcast; of the rows that occur
    # again, the planner knows the written size
    gone = gone.hint("merge")
    is_gone = (F.col("uid") == F.col("gone_uid")) & (F.col("k_text") == F.col("gone_text"))
    once = join_on_doc_key(keyed, again, "left_anti", grows=False).join(gone, is_gone, "left_anti")
    twice = join_on_doc_key(keyed, again, "left_semi", grows=False).join(gone, is_gone, "left_anti")
    return once.union(twice.dropDuplicates(["k_id", "k_text"])).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, dealt to the written files in the order of the mix."""
    let_workers_import(spark)
    return pfair.in_mix_order(pfair.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def written_place(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` and ``mix_position``, the row's place in the order that its
    files were written in; null where ``docs`` was not read from files."""
    try:
        docs = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("file_row"))
    except AnalysisException:  # rows made in memory have no written order
        return docs.select(*COLUMNS, F.lit(None).cast("long").alias("mix_position"))
    scratch = Scratch(spark)
    counts = docs.groupBy("file").agg(F.count("*").alias("n"))
    # one row a file, so neither the window nor the table grows with the rows
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = F.coalesce(F.sum("n").over(Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = scratch.table(counts.select("file", before.alias("file_before")))
    scratch.clear(files)
    # the planner knows the written size, a row a file
    return docs.join(files, "file").select(*COLUMNS, (F.col("file_before") + F.col("file_row")).alias("mix_position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, a digest of the text they decode to, and
    ``mix_position``, the document's place (from 0) in the order that the mix stage wrote.
    Null and empty texts have no ids; columns beside those of ``documents`` are left out."""
    let_workers_import(spark)
    out = bpe.encode_decode(written_place(spark, docs), public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source", "mix_position"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"), "mix_position")


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe_encode_decode", encode),
]

#: The classifier, the perfect hash, the signatures and the encoder are beyond SQL; a
#: brute-force version in tests/llm checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows written as Parquet and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.table(out)
        scratch.clear(docs)
    return docs
