"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from catloom.llm import (
    brown, exact_dedup, hard_negatives, html_text, merkle, mixing, neighbours, packing, pair_quality, rans, rule_forest, secrets, simhash,
)
from catloom.llm.common import table
from catloom.runtime import work_folder


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.encode(exact_dedup.normalised("text"), "UTF-8"), 256).alias("text_sha256")
    return exact_dedup.exact_dedup(table(spark, sf, "documents"), extra=[digest])


OP1_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf, "documents"))


def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf, "documents"))


def op5_brown(spark: SparkSession, sf: str) -> DataFrame:
    return brown.brown_scores(table(spark, sf, "documents"))


def op6_rans(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{work_folder(spark)}/tokens"
    rans.write_tokens(table(spark, sf, "documents"), folder)
    return rans.read_tokens(spark, folder).drop("tokens")


def op7_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf, "pages"))


def op8_forest_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rule_forest.forest_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_pair_quality(spark: SparkSession, sf: str) -> DataFrame:
    return pair_quality.pair_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


def op12_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf, "documents")).drop("version_nodes")


# CRC-32 of the decimal id bit by bit; levels by recursion; a tampered leaf climbs past its siblings.
OP13_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, list_reduce(
      list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text
  FROM documents),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM raw),
low(lang, level, pos, n, h) AS (
  SELECT lang, 0, pos, n, h FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY ALL),
tops AS (
  SELECT lang, level AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM tops
  UNION ALL SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY ALL),
beside AS (
  SELECT 'low' AS part, lang, level, pos, n,
    coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM low
  UNION ALL SELECT 'high', NULL, level, pos, n,
    coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM high),
steps AS (
  SELECT d.doc_id, t.subroot, d.h AS leaf, coalesce(d.other, d.h) AS own, t.depth, t.pos AS top, d.pos, d.lang FROM leaves AS d JOIN tops AS t ON d.lang IS NOT DISTINCT FROM t.lang),
climb(doc_id, level, folded, proof) AS (
  SELECT doc_id, 0, own, '' FROM steps
  UNION ALL
  SELECT c.doc_id, c.level + 1, sha256(b.l || folded || b.r), proof || b.l || b.r
  FROM climb AS c JOIN steps AS s USING (doc_id) JOIN beside AS b ON b.n > 1 AND (
    (c.level < s.depth AND b.part = 'low' AND b.lang IS NOT DISTINCT FROM s.lang AND b.level = c.level AND b.pos = s.pos // (8 ** c.level)::BIGINT)
    OR (c.level >= s.depth AND b.part = 'high' AND b.level = c.level - s.depth AND b.pos = s.top // (8 ** (c.level - s.depth))::BIGINT))),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb JOIN steps USING (doc_id), root QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_packing, op3_simhash, op4_secrets, op5_brown, op6_rans, op7_html_text, op8_forest_rules,
        op9_mixing, op10_pair_quality, op11_hard_negatives, op12_neighbours, op13_merkle,
    )
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op11_hard_negatives": OP11_SQL, "op13_merkle": OP13_SQL}
