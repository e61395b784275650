"""Host-level quality rules (operator 11), native: built-in functions only.

1. Each text's counts are one expression over its words and lines, inside its row; no
   word or window leaves the row. They are written once, a few numbers a document.
2. Failures of each rule are summed by host with partial aggregates, so a host that holds
   a third of all rows is combined where its rows lie.
3. A rule's rates over hosts are modelled as draws of a beta distribution whose mean and
   strength are estimated from all hosts (analysis of variance of grouped rates). A host's
   rate is the posterior mean (failures + mean x strength) / (documents + strength), so a
   host of few documents stays near the common rate.
4. A host fails if the posterior rate of any rule passes ``HOST_LIMIT`` by ``CAUTION``
   posterior standard deviations, so one bad document convicts no host; the verdicts are
   joined back to the written counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from postmill.llm.common import Scratch, doc_key, join_on_doc_key
from postmill.llm.quality import strength

BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20     # of the words, in windows found twice or more
SYMBOL_PERCENT = 10     # symbols for each hundred code points in words
DUP_LINE_PERCENT = 30   # of the lines with a word
HOST_LIMIT = 0.5
CAUTION = 2.0
LEAST_STRENGTH = 2.0    # documents that the prior counts for, where hosts are all clean or all bad

BASE = ("few_words", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Each rule says when a document fails, by its counts.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {SYMBOL_PERCENT} * word_chars",
    "dup_lines": f"100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines",
}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def covered(starts: Column) -> Column:
    """Positions covered by windows that start at ``starts`` (ascending)."""
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), step, lambda a: a["n"])


def repeat_words(ws: Column) -> Column:
    """Words in windows found twice or more, the first included. Windows are told apart by
    64-bit hashes; equal ones become neighbours when sorted, so the work is n log n."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def found_again(placed: Column) -> Column:
        twice = F.filter(placed, lambda x, k: F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False)))
        return covered(F.sort_array(F.transform(twice, lambda x: x["p"])))

    def repeats(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed, found_again))

    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(
        bind(F.transform(ws, lambda w: F.xxhash64(w)), lambda hashes: bind(windows(hashes), repeats)))


def counts(text: Column) -> Column:
    """A struct of ``COUNTS`` (long): words, their code points, symbols, lines with a word,
    those equal to an earlier one, and words in repeated windows. A null text has none."""

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

        def of_words(ws: Column) -> Column:
            def of_lines(ls: Column) -> Column:
                made = (F.size(ws), F.char_length(F.array_join(ws, "")), F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, "")),
                        F.size(ls), F.size(ls) - F.size(F.array_distinct(ls)), repeat_words(ws))
                return F.struct(*[c.cast("long").alias(name) for c, name in zip(made, COUNTS)])
            return bind(lines, of_lines)
        return bind(words(t), of_words)

    return bind(F.coalesce(text.cast("string"), F.lit("")), of_text)


def measure(docs: DataFrame, text_col: str, id_col: str, host_col: str) -> DataFrame:
    """(k_id, k_text, host, counts...) of every row; a null host is a host of its own."""
    host = F.coalesce(F.concat(F.lit("="), docs[host_col].cast("string")), F.lit(""))
    rows = docs.select(*doc_key(docs[id_col], docs[text_col].cast("string")), host.alias("host"), counts(docs[text_col]).alias("c"))
    return rows.select("k_id", "k_text", "host", "c.*")


def host_rates(measured: DataFrame, scratch: Scratch, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_n, host_<rule>, host_failed) in one row a host: the posterior rate of each
    rule, and whether one of them passes ``limit`` with caution."""
    failed = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    hosts = scratch.table(measured.groupBy("host").agg(F.count("*").alias("host_n"), *failed))
    n, sums = F.col("host_n"), [F.count("*").alias("hosts"), F.sum("host_n").alias("rows"), F.sum(F.pow("host_n", F.lit(2.0))).alias("squares")]
    total = hosts.agg(*sums, *[F.sum(name).alias(name) for name in RULES]).first()
    rows = total["rows"] or 1
    mean = {name: (total[name] or 0) / rows for name in RULES}
    spread = hosts.agg(*[x for name in RULES for rate in [F.col(name) / n] for x in (
        F.sum(n * F.pow(rate - mean[name], 2)).alias(f"{name}_b"), F.sum(n * rate * (1 - rate)).alias(f"{name}_w"))]).first()
    prior = {name: max(LEAST_STRENGTH, strength(spread[f"{name}_b"] or 0, spread[f"{name}_w"] or 0, total["hosts"], rows, total["squares"] or 0)) for name in RULES}
    rates = hosts.select("host", "host_n", *[((F.col(name) + mean[name] * prior[name]) / (n + prior[name])).alias(f"host_{name}") for name in RULES])
    # a beta distribution of strength s has the variance rate (1 - rate) / (s + 1)
    low = [F.col(c) - CAUTION * F.sqrt(F.col(c) * (1 - F.col(c)) / (n + prior[name] + 1)) for name in RULES for c in [f"host_{name}"]]
    return rates.withColumn("host_failed", F.greatest(*low) > limit)


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each row of ``docs``: k_id, k_text, host, the ``COUNTS``, ``base_failed``,
    ``host_n``, ``host_<rule>`` (posterior rate), ``host_failed`` and ``kept``.

    ``base_failed`` says that the document itself fails one of ``BASE``. ``kept`` is false
    for these and for documents of a host with a rule's rate clearly over ``limit``. Null and
    empty texts have no words, so they fail; rows that repeat each count, and so does a
    null host. No other column of ``docs`` is read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    measured = scratch.table(measure(docs, text_col, id_col, host_col))
    rates = scratch.table(host_rates(measured, scratch, limit))
    scratch.clear(measured, rates)
    # the planner knows the written size of the hosts' table; a hot host is split by AQE
    return (measured.join(rates, "host")
            .withColumn("base_failed", F.expr(" OR ".join(f"({RULES[name]})" for name in BASE)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
            .select("k_id", "k_text", "host", *COUNTS, "base_failed", "host_n", *[f"host_{name}" for name in RULES], "host_failed", "kept"))


def keep_passing(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``judge`` keeps. Rows equal in id and text but
    of different hosts go if any of their hosts fails."""
    rejected = judge(docs, text_col, id_col, host_col, limit).filter("NOT kept").select("k_id", "k_text").distinct()
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), *doc_key(docs[id_col], docs[text_col].cast("string")))
    return join_on_doc_key(rows, rejected, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
