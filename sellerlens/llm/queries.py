"""The corpus operators as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens.llm import (
    binary_ids,
    conversation_trie,
    hnsw,
    html_text,
    licences,
    line_dedup,
    minhash,
    mixing,
    packing,
    pq_dedup,
    sentence_pieces,
    toxicity,
    whitening,
)
from sellerlens.llm.shared import table


def op1_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), with_ids=False)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_dedup.without_boilerplate(docs, size="n_chars").select("doc_id", "source", "text", "n_chars")


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pq_dedup.near_vectors(table(spark, folder, "embeddings"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mixture(table(spark, folder, "documents"))
    return taken.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_tokens", "epoch", "block", "before")


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hnsw.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op10_binary_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return binary_ids.checksums(*binary_ids.write_ids(table(spark, folder, "documents")))


def op11_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.round_trip(table(spark, folder, "documents")))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.trie(table(spark, folder, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_licence_scan, op2_packing, op3_line_dedup, op4_embedding_near_dedup, op5_source_mixing,
        op6_minhash_near_dedup, op7_nearest_neighbours, op8_toxicity, op9_html_extraction, op10_binary_token_ids,
        op11_sentence_pieces, op12_embedding_whitening, op13_conversation_trie,
    ]
    return {f.__name__: f for f in found}


_TRIMMED = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT source, {_TRIMMED} AS t, count(DISTINCT doc_id) AS n FROM lines WHERE {_TRIMMED} <> '' GROUP BY ALL
), totals AS (
  SELECT source, count(*) AS total FROM documents GROUP BY ALL
), bad AS (
  SELECT c.source, c.t FROM counted c JOIN totals s ON c.source IS NOT DISTINCT FROM s.source
  WHERE c.n >= {line_dedup.PAGES} AND c.n > s.total * {line_dedup.RATIO}
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS text
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND {_TRIMMED} = b.t
  WHERE b.t IS NULL GROUP BY l.doc_id
), renewed AS (
  SELECT d.doc_id, d.source, d.text AS old, d.n_chars,
         CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
  FROM documents d LEFT JOIN kept k USING (doc_id)
)
SELECT doc_id, source, text,
       CASE WHEN text IS DISTINCT FROM old THEN length(text)::BIGINT ELSE n_chars END AS n_chars
FROM renewed
"""

_NORM = "list_sum(list_transform(logs, lambda x: exp({a} * x)))"
_ENTROPY = f"(ln({_NORM}) - {{a}} * list_sum(list_transform(logs, lambda x: x * exp({{a}} * x))) / {_NORM})"
_FITS = f"({mixing.BUDGET} * total * exp({{a}} * logs[1]) / {_NORM} / smallest <= {mixing.REPEATS})"
_MID = "((lo + hi) / 2)"

MIXING_SQL = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM documents
), s AS (
  SELECT source, count(*) AS n_rows, sum(tokens)::BIGINT AS n_tokens FROM t GROUP BY source
), c AS (
  SELECT sum(n_tokens)::DOUBLE AS total, max(n_tokens)::DOUBLE AS largest, min(n_tokens)::DOUBLE AS smallest,
         list_sort(list(ln(n_tokens::DOUBLE / (SELECT max(n_tokens) FROM s)::DOUBLE))) AS logs
  FROM s WHERE n_tokens > 0
), goal AS (
  SELECT *, {_ENTROPY.format(a="1.0::DOUBLE")} * (1 - {mixing.GAP}) + ln(len(logs)::DOUBLE) * {mixing.GAP} AS target FROM c
), one AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN {_ENTROPY.format(a=_MID)} >= target THEN {_MID} ELSE lo END,
         CASE WHEN {_ENTROPY.format(a=_MID)} >= target THEN hi ELSE {_MID} END
  FROM one, goal WHERE k < {mixing.STEPS}
), first AS (SELECT lo AS alpha_e FROM one WHERE k = {mixing.STEPS}), two AS (
  SELECT 0 AS k, alpha_e AS lo, 1.0::DOUBLE AS hi FROM first
  UNION ALL
  SELECT k + 1, CASE WHEN {_FITS.format(a=_MID)} THEN lo ELSE {_MID} END, CASE WHEN {_FITS.format(a=_MID)} THEN {_MID} ELSE hi END
  FROM two, goal WHERE k < {mixing.STEPS}
), chosen AS (
  SELECT goal.*, round(CASE WHEN {_FITS.format(a="alpha_e")} THEN alpha_e ELSE (SELECT hi FROM two WHERE k = {mixing.STEPS}) END, 9) AS alpha
  FROM goal, first
), shares AS (
  SELECT source, n_rows, n_tokens, CASE WHEN n_tokens > 0 THEN floor(
           round(exp(alpha * ln(n_tokens / largest)) / {_NORM.format(a="alpha")}, 12) * ({mixing.BUDGET} * total) + 0.5)::BIGINT ELSE 0 END AS share
  FROM s, chosen
), plan AS (
  SELECT source, greatest(1, ceil(n_rows / {mixing.BLOCK}.0))::BIGINT AS blocks,
         CASE WHEN n_tokens > 0 THEN share // n_tokens ELSE 0 END AS whole, CASE WHEN n_tokens > 0 THEN share % n_tokens ELSE 0 END AS rest
  FROM shares
), dealt AS (
  SELECT t.*, whole, rest,
         ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', 'block', coalesce(doc_id::VARCHAR, '-'), coalesce(md5(text), '-'))), 1, 12))::BIGINT % blocks AS block
  FROM t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source WHERE whole > 0 OR rest > 0
), epochs AS (
  SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END))::BIGINT AS epoch FROM dealt
), sized AS (
  SELECT source, epoch, block, sum(tokens)::BIGINT AS size FROM epochs GROUP BY ALL
), begins AS (
  SELECT source, epoch, block, (sum(size) OVER (PARTITION BY source, epoch ORDER BY
           md5(concat_ws('|', '{mixing.SEED}', 'order', coalesce(source, '-'), epoch::VARCHAR, block::VARCHAR)), block) - size)::BIGINT AS begin
  FROM sized
), placed AS (
  SELECT d.*, (b.begin + sum(tokens) OVER (PARTITION BY d.source, d.epoch, d.block ORDER BY
           md5(concat_ws('|', '{mixing.SEED}', 'row', d.epoch::VARCHAR, coalesce(doc_id::VARCHAR, '-'))), tokens, text
           ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS before
  FROM epochs d JOIN begins b ON d.source IS NOT DISTINCT FROM b.source AND d.epoch = b.epoch AND d.block = b.block
)
SELECT doc_id, source, tokens AS n_tokens, epoch, block, before
FROM placed WHERE epoch < whole OR before < rest
"""


# CRC-32 of the decimal id, bit by bit; 3988292384 is its polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ord(z)::BIGINT)),
    lambda c, z: list_reduce(list_prepend(xor(c, z), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                             lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - ((conv_id % 100) + 100) % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), s AS (
  SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY part, i) FILTER (WHERE i IS NOT NULL), []) AS s
  FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, len(s) AS l, unnest(range(0, len(s) + 1)) AS d, s FROM s
), n AS (
  SELECT d AS depth, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE l = d), '')) AS ends_sha256
  FROM p GROUP BY ALL
), k AS (
  SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.p = k.p
), below AS (
  SELECT p[1:a] AS p, a AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT p, unnest(range(0, depth + 1)) AS a, n_children,
               CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].text) END AS saved FROM m)
  GROUP BY ALL
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, b.n_leaves, b.saved_tokens, m.ends_sha256
FROM m JOIN below b ON m.depth = b.depth AND m.p = b.p LEFT JOIN n u ON u.depth = m.depth - 1 AND u.p = m.p[1:m.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP_SQL, "op5_source_mixing": MIXING_SQL, "op13_conversation_trie": TRIE_SQL}
