"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import (
    best_fit,
    exact_dedup,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic,
    prefix_trie,
    recompression,
    suffix_dedup,
    tokens,
    toxicity,
)
from wayfarer.llm.common import documents, session


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.drop_repeated_bytes(documents(session(spark), sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.drop_repeated_windows(documents(session(spark), sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(session(spark), sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spark.wayfarer.tokenCache`` names a cache table to keep from run to run; unset, each run starts one."""
    cache = spark.conf.get("spark.wayfarer.tokenCache", None)
    return tokens.count_tokens(documents(session(spark), sf_dir), cache=cache)


def near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join of the fingerprints: verified links between documents and representatives."""
    return fingerprints.near_duplicates(documents(session(spark), sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_chunks(documents(session(spark), sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(session(spark), sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_next(documents(session(spark), sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(documents(session(spark), sf_dir))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(session(spark), sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_scores(documents(session(spark), sf_dir), labels)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(documents(session(spark), sf_dir), periodic.planted_period)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(documents(session(spark), sf_dir))


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_recompression": op2_recompression,
        "op3_packing": op3_packing,
        "op4_token_counts": op4_token_counts,
        "op5_line_dedup": op5_line_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_fingerprints": op7_fingerprints,
        "near_duplicate_links": near_duplicate_links,
        "op8_ngram_join": op8_ngram_join,
        "op9_mix_sources": op9_mix_sources,
        "op10_toxicity": op10_toxicity,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


def oracle_sql() -> dict:
    return {"op6_exact_dedup": OP6_SQL, "op9_mix_sources": OP9_SQL, "op11_prefix_trie": OP11_SQL}


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""

OP9_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, ((SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM n)::DOUBLE) / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, k,
             sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT d.*, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM documents d),
a AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
m AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars,
             len(list_filter(a.cdf, lambda x: x <= u.u)) AS n_copies
      FROM u JOIN a ON u.source IS NOT DISTINCT FROM a.source),
e AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM m WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
       ('0x' || substr(md5('19:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key
FROM e
"""

#: crc32 goes bit by bit over the decimal id; a node's subtree are the nodes whose smallest member passes through it.
OP11_SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i, digest, chars
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
               sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, max(i) AS n_own FROM own GROUP BY conv_id),
crc AS (SELECT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS c FROM n
  UNION ALL
  SELECT conv_id, s, k + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * length(s))),
h AS (SELECT conv_id, (4294967295 - c) % 6 AS h FROM crc WHERE k = 8 * length(s)),
z AS (SELECT n.conv_id, n.conv_id - n.conv_id % 100 AS base, h, least(h, coalesce(b.n_own, 0)) AS taken,
             least(h, coalesce(b.n_own, 0)) + greatest(0, n.n_own - h) AS size
      FROM n JOIN h USING (conv_id) LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % 100),
t AS (SELECT z.conv_id, i AS depth, digest, chars, size FROM z JOIN own ON own.conv_id = z.base WHERE i <= taken
  UNION ALL SELECT z.conv_id, taken + i - h, digest, chars, size FROM z JOIN own USING (conv_id) WHERE i > h),
m AS (SELECT conv_id, 0 AS depth, '' AS name, 0 AS chars, size FROM z
  UNION ALL
  SELECT conv_id, depth, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)), chars, size FROM t),
v AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
      FROM m GROUP BY depth, name),
p AS (SELECT v.*, a.conv_id AS parent_conv_id
      FROM v LEFT JOIN m ON m.conv_id = v.conv_id AND m.depth = v.depth - 1 LEFT JOIN v a ON a.depth = m.depth AND a.name = m.name),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
u AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT m.depth, m.name, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * u.chars)::BIGINT AS saved_tokens
      FROM u JOIN m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.depth, m.name)
SELECT p.conv_id, p.depth::BIGINT AS depth, parent_conv_id, p.n_convs, n_children, n_leaves, saved_tokens, p.ends_sha256
FROM p JOIN u USING (depth, name) JOIN s USING (depth, name)
"""
