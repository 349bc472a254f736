"""The ten operators over the tables they are meant for, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, jaccard_join, kneser_ney, language_id, mixing, secret_scan, sentence_pieces, suffix_dedup, token_store
from ._work import Workspace, documents

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op1"), threshold=0.98)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), Workspace(spark, "op2"), weights=(5, 2, 1), max_repeat=3.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op3")
    return token_store.read_store(work, token_store.write_store(documents(spark, sf_dir), work, BYTE_BPE, end_id=0))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), Workspace(spark, "op4"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), Workspace(spark, "op5"), PIECES, folds=5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir), Workspace(spark, "op6"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_components(documents(spark, sf_dir), Workspace(spark, "op7"), width=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir), Workspace(spark, "op8"))
    return out.select(out.id.alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(documents(spark, sf_dir), Workspace(spark, "op9"), PIECES)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "op10"), documents(spark, sf_dir)
    model = kneser_ney.train(docs, work, folds=5, held=1)
    return kneser_ney.score(docs, work, model, folds=5, held=1)


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_mixing, op3_token_store, op4_suffix_dedup, op5_language_id, op6_secret_scan, op7_jaccard_join, op8_exact_dedup, op9_sentence_pieces, op10_kneser_ney)}

OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, row_number() OVER () AS rn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM sizes),
capped AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM capped WINDOW o AS (ORDER BY cap / weight, source COLLATE "binary" NULLS LAST)),
level AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source COLLATE "binary" NULLS LAST LIMIT 1),
plan AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM level), 0) * weight)::DOUBLE AS target FROM levels),
rests AS (SELECT source, source_size, target, whole, target - whole * source_size AS rest
          FROM (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM plan)),
levels_in AS (SELECT s.source, s.size, (r.rest - coalesce(sum(s.size * s.n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                     / (sum(s.size * s.size * s.n) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS l
              FROM (SELECT source, size, count(*) AS n FROM docs WHERE size > 0 GROUP BY source, size) s
              JOIN rests r ON s.source IS NOT DISTINCT FROM r.source AND r.rest > 0 WINDOW o AS (PARTITION BY s.source ORDER BY s.size DESC)),
chances AS (SELECT source, arg_max(l, size) AS l FROM levels_in WHERE l * size <= 1 GROUP BY source),
ranked AS (SELECT d.*, r.rest, (d.u / (1 - d.u)) / (p / (1 - p)) AS odds
           FROM (SELECT d.*, greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, c.l * d.size)) AS p FROM docs d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source WHERE d.size > 0) d
           JOIN rests r ON d.source IS NOT DISTINCT FROM r.source),
first AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, size, doc_id NULLS LAST, rn ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM ranked),
gapped AS (SELECT *, rest - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM first),
second AS (SELECT *, size <= gap AND sum(CASE WHEN size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, size, doc_id NULLS LAST, rn ROWS UNBOUNDED PRECEDING) <= gap AS follows
           FROM gapped WHERE NOT fits),
ended AS (SELECT *, gap - sum(CASE WHEN follows THEN size ELSE 0 END) OVER (PARTITION BY source) AS still FROM second),
closing AS (SELECT rn, row_number() OVER (PARTITION BY source ORDER BY abs(still - size), odds, size, doc_id NULLS LAST, rn) AS place
            FROM ended WHERE NOT follows AND abs(still - size) < still),
taken AS (SELECT rn FROM first WHERE fits UNION ALL SELECT rn FROM second WHERE follows UNION ALL SELECT rn FROM closing WHERE place = 1)
SELECT d.doc_id, d.size, r.source_size, r.target, ((r.whole + CASE WHEN t.rn IS NULL THEN 0 ELSE 1 END) * d.size)::BIGINT AS taken
FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN taken t ON t.rn = d.rn
"""

OP8_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""

ORACLES = {"op2_mixing": OP2_SQL, "op8_exact_dedup": OP8_SQL}
