"""A training-data pipeline over `documents`: language ID, exact dedup, near dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, language_id, mixing, sentence_pieces
from tessera.llm._bytes import fresh
from tessera.llm._work import Workspace, documents
from tessera.llm.queries import PIECES

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, or without a clear language, go."""
    pred, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    told = language_id.identify(docs, Workspace(spark, "language"), PIECES, keep=True)
    return told.filter((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id."""
    return exact_dedup.drop_copies(docs, Workspace(spark, "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8, that of the smallest id."""
    return jaccard_join.drop_near_copies(docs, Workspace(spark, "near"), width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn, each document as often as the mix takes it."""
    return mixing.mixed_rows(docs, Workspace(spark, "mix"), weights=(5, 2, 1), max_repeat=3.0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mix, with a digest of what they decode to."""
    return sentence_pieces.encode(docs, Workspace(spark, "pieces"), PIECES, with_ids=True)


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("SentencePiece", pieces)]

#: Language models and piece segmentation are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written before the next reads them."""
    work, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
