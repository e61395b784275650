"""Quality classification with hierarchical empirical Bayes site priors (operator 6).

A logistic model gives each document's evidence: the log-likelihood ratio of good
against bad text. Soft counts of good documents are aggregated by host and by path
within the host. Rates are shrunk path -> host -> global mean; how strongly is estimated
from the data by the analysis of variance of the grouped rates, so sparse sites stay
near the prior. A document's posterior joins its evidence with its path's rate, from
which its own share is taken out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postmill.llm.common import checkpointed, doc_key, hash_sample, join_on_doc_key, slices

SAMPLE = 6000     # labelled documents the model is fitted on, at most
HASHED = 256      # dimensions of the word-shape features
RIDGE = 1e-3
STEPS = 300
KEEP_AT = 0.5
CACHE = 200_000
SHAPE = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
REPEAT = re.compile(r"(.)\1+")


class Features:
    """A text's feature vector: shares of character kinds, repetition, and hashed word shapes."""

    size = 12 + HASHED

    def __init__(self):
        self.known: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        """Hash of a word's shape: letters, capitals, digits and marks, runs made one."""
        shape = word.translate(SHAPE)
        if not shape.isascii():
            shape = "".join("a" if c.islower() else "A" if c.isupper() else c for c in shape)
        return zlib.crc32(REPEAT.sub(r"\1", shape).encode()) % HASHED

    def vector(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        words = text.split() if text else []
        if not words:
            out[0] = 1.0
            return out
        n, chars, known = len(words), len(text), self.known
        if len(known) > CACHE:
            known.clear()
        counts = Counter(words)
        for w, c in counts.items():
            slot = known.get(w)
            if slot is None:
                slot = known[w] = self._slot(w)
            out[12 + slot] += c
        out[12:] = np.sqrt(out[12:] / n)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lines = text.split("\n")
        out[1] = np.log1p(n) / 10
        out[2] = len(counts) / n
        out[3] = sum(a == b for a, b in zip(words, words[1:])) / n
        out[4] = counts.most_common(1)[0][1] / n
        out[5] = (sum(map(len, words)) / n) / 10
        out[6] = ((codes >= 65) & (codes <= 90)).sum() / chars
        out[7] = ((codes >= 48) & (codes <= 57)).sum() / chars
        out[8] = ((codes > 32) & (codes < 127)).sum() / chars - out[6] - out[7] - ((codes >= 97) & (codes <= 122)).sum() / chars
        out[9] = (codes > 127).sum() / chars
        out[10] = len(lines) / n
        out[11] = 1 - len(set(lines)) / len(lines)
        return out


class Logistic:
    """Ridge logistic regression on standardized features; evidence leaves the class shares out."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-6] = 1.0
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.w, self.prior = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
        bias, m, v, rate = self.prior, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0.05
        for t in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w + bias, -30, 30)))
            g = np.append(z.T @ (p - y) / len(y) + RIDGE * self.w, (p - y).mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w -= step[:-1]
            bias -= step[-1]
        self.bias = float(bias)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good against bad."""
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.bias - self.prior, -20, 20)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
        sample: int = SAMPLE) -> Logistic | None:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of the id; None if a class is missing.

    Rows with a null id or label take no part.
    """
    known = labels.select(labels[id_col].alias("l_id"), labels[label_col].cast("double").alias("y")).dropna()
    chosen = hash_sample(known, "l_id", sample, known.count())
    # at most ``sample`` rows
    rows = docs.select(docs[id_col].alias("l_id"), docs[text_col].cast("string").alias("t")).join(F.broadcast(chosen), "l_id").select("y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            for start, size in slices(batch.column(1)):
                part = batch.slice(start, size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.vector(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["y", "x"])

    got = rows.mapInArrow(run, "y double, x binary").collect()
    y = np.array([r["y"] > 0 for r in got], float)
    if not 0 < y.sum() < len(y):
        return None
    return Logistic(np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64), y)


def evidence(docs: DataFrame, model: Logistic | None, text_col: str, id_col: str, host: Column, path: Column) -> DataFrame:
    """(k_id, k_text, host, path, llr) of every row; without a model the evidence is 0."""
    src = docs.select(*doc_key(docs[id_col], docs[text_col]), host.alias("host"), path.alias("path"), docs[text_col].cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, model = Features(), shared.value
        for batch in batches:
            for start, size in slices(batch.column(4)):
                part = batch.slice(start, size)
                llr = np.zeros(size)
                if model is not None:
                    llr = model.evidence(np.array([f.vector(t) for t in part.column(4).to_pylist()], np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(llr, pa.float64())], names=["k_id", "k_text", "host", "path", "llr"])

    return src.mapInArrow(run, "k_id long, k_text long, host string, path string, llr double")


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def strength(between: float, within: float, groups: float, rows: float, squares: float) -> float:
    """Prior strength (rows) from the analysis of variance of grouped rates.

    ``between`` is the sum of n (rate - centre)^2 over the groups, ``within`` that of
    n rate (1 - rate), ``squares`` that of n^2. The intraclass correlation rho gives
    strength (1 - rho) / rho: strong shrinkage where groups hardly differ.
    """
    if groups < 2 or rows <= groups:
        return 1e6
    msb, msw = between / (groups - 1), within / (rows - groups)
    size = (rows - squares / rows) / (groups - 1)
    rho = (msb - msw) / max(msb + (size - 1) * msw, 1e-12)
    rho = min(max(rho, 1e-6), 1 - 1e-6)
    return (1 - rho) / rho


def site_rates(scored: DataFrame, prior: float) -> tuple[DataFrame, dict]:
    """(host, path, path_n, path_s, host_n, host_s) and the global numbers of the hierarchy."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("llr") + F.lit(prior))))
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum(p).alias("path_s")))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s")))
    rates = checkpointed(paths.join(hosts, "host"))
    top = hosts.agg(F.count("*").alias("g"), F.coalesce(F.sum("host_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("host_s"), F.lit(0.0)).alias("s")).first()
    mean = min(max(top["s"] / top["n"], 1e-3), 1 - 1e-3) if top["n"] else 0.5

    def parts(n: str, s: str, centre: Column) -> list[Column]:
        rate = F.col(s) / F.col(n)
        return [F.coalesce(F.sum(F.col(n) * F.pow(rate - centre, 2)), F.lit(0.0)), F.coalesce(F.sum(F.col(n) * rate * (1 - rate)), F.lit(0.0)),
                F.count("*"), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(F.col(n).cast("double") * F.col(n)), F.lit(0.0))]

    at_host = strength(*map(float, hosts.agg(*parts("host_n", "host_s", F.lit(mean))).first()))
    inside = list(map(float, rates.agg(*parts("path_n", "path_s", F.col("host_s") / F.col("host_n"))).first()))
    inside[2] = inside[2] - top["g"] + 1  # degrees of freedom: each host has its own centre
    return rates, {"mean": mean, "host_strength": at_host, "path_strength": strength(*inside)}


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
             host: str = "source", path: str = "lang", sample: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """One row for each row of ``docs``: k_id, k_text, llr, host_rate, path_rate, posterior, kept.

    ``host`` and ``path`` name the site columns; nulls are a site of their own. The
    rates are those without the document itself. A document is kept if its posterior
    reaches ``keep_at``. Null and empty texts have a feature vector of their own.
    Without labels of both classes there is no evidence and all rows are kept.
    Repeated rows each count.
    """
    model = fit(docs, labels, text_col, id_col, label_col, sample)
    site = [F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("")) for c in (host, path)]
    scored = checkpointed(evidence(docs, model, text_col, id_col, *site))
    prior = 0.0 if model is None else model.prior
    rates, top = site_rates(scored, prior)
    own = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("llr") + F.lit(prior))))

    def rate(s: str, n: str, centre: Column, k: float) -> Column:
        return F.least(F.greatest((F.col(s) - own + k * centre) / (F.col(n) - 1 + k), F.lit(1e-4)), F.lit(1 - 1e-4))

    return (scored.join(rates, ["host", "path"])
            .withColumn("host_rate", rate("host_s", "host_n", F.lit(top["mean"]), top["host_strength"]))
            .withColumn("path_rate", rate("path_s", "path_n", F.col("host_rate"), top["path_strength"]))
            .withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("llr") + logit(F.col("path_rate"))))))
            .withColumn("kept", F.lit(model is None) | (F.col("posterior") >= keep_at))
            .select("k_id", "k_text", "llr", "host_rate", "path_rate", "posterior", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``classify`` keeps."""
    rejected = classify(docs, labels, text_col, id_col, **options).filter("NOT kept").select("k_id", "k_text")
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), *doc_key(docs[id_col], docs[text_col]))
    return join_on_doc_key(rows, rejected, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
