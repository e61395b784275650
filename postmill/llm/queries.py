"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postmill.llm import ann, bpe, dartminhash, hostrules, htmlcrf, langid, linededup, pfair, phrases, quality, tokencount, topk, variants
from postmill.session import let_workers_import
from postmill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query
    return register


@_query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.crc_fold(docs["doc_id"])
    profiles = langid.learn_profiles(docs.filter(fold != 1))
    return (langid.predict_langs(docs, profiles)
            .select("doc_id", F.coalesce(langid.crc_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"))


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{linededup.UPPER}', '{linededup.LOWER}') AS key FROM l),
c AS (SELECT key AS common FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN common IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.common GROUP BY r, doc_id
"""


@_query("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_n_lines").alias("n_lines"), F.col("line_n_dropped").alias("n_dropped"),
                      F.sha2("text", 256).alias("kept_sha256"))


@_query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmlcrf.extract(pages, htmlcrf.train(pages))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op4_exact_top_k", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


@_query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


@_query("op7_bpe_round_trip")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


@_query("op10_near_duplicates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dartminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("uid").alias("doc_id"), "class_id", "exact_id", "kept")


@_query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@_query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("k_id").alias("doc_id"), "llr", "host_rate", "path_rate", "posterior", "kept")


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws FROM d),
o AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM o),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM m WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
        WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY r),
c AS (SELECT d.r, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(translate(t, '{hostrules.SYMBOLS}', '')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT source, unnest([{', '.join(f"{{'rule': '{k}', 'x': CAST({v} AS INTEGER)}}" for k, v in hostrules.RULES.items())}], recursive := true) FROM c),
h AS (SELECT rule, source, count(*) AS n, sum(x) AS x, sum(x) / count(*) AS p FROM f GROUP BY rule, source),
t AS (SELECT rule, count(*) AS g, sum(n) AS rows, sum(CAST(n AS DOUBLE) * n) AS squares, sum(x) / sum(n) AS mean, sum(n * p * (1 - p)) AS within FROM h GROUP BY rule),
b AS (SELECT t.*, (SELECT sum(h.n * (h.p - t.mean) ** 2) FROM h WHERE h.rule = t.rule) / (g - 1) AS msb, within / (rows - g) AS msw,
             (rows - squares / rows) / (g - 1) AS size FROM t),
k AS (SELECT rule, mean, least(greatest((msb - msw) / greatest(msb + (size - 1) * msw, 1e-12), 1e-6), 1 - 1e-6) AS rho FROM b),
p AS (SELECT source, n + st AS s, (x + mean * st) / (n + st) AS rate
      FROM h JOIN (SELECT rule, mean, greatest({hostrules.LEAST_STRENGTH}, (1 - rho) / rho) AS st FROM k) USING (rule)),
v AS (SELECT source, bool_or(rate - {hostrules.CAUTION} * sqrt(rate * (1 - rate) / (s + 1)) > {hostrules.HOST_LIMIT}) AS host_failed FROM p GROUP BY source),
j AS (SELECT c.*, {' OR '.join(f"({hostrules.RULES[k]})" for k in hostrules.BASE)} AS base_failed, host_failed
      FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host_failed FROM j
"""


@_query("op11_host_rules", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hostrules.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("k_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


OP12_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{linededup.UPPER}', '{linededup.LOWER}') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n-\\r]')) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS p FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY lang, p),
c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1 AND f >= {phrases.LEAST}),
s AS (SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r,
             CAST(CAST({phrases.SCALE} AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
t AS (SELECT lang, q, max(a) AS longer FROM (SELECT lang, a, unnest([p[1:2], p[2:3]]) AS q FROM b WHERE len(p) = 3) GROUP BY lang, q),
o AS (SELECT b.lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN t ON t.lang = b.lang AND t.q = b.p
      WHERE longer IS NULL OR 100 * longer < {phrases.LONGER_PERCENT} * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= {phrases.TOP}
"""


@_query("op12_phrases", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


@_query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))
