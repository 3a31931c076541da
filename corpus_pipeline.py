"""A corpus pipeline from five of the operators: quality, exact dedup, near dedup, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``docs``. ``run`` writes what a stage returns in the shared folder and reads it
back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm import exact_dedup, mixing, ngram_join, quality_crf, sentencepiece_codec
from vintage.llm.queries import piece_model, table
from vintage.llm.shared import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    score = "__score"  # not a column name that documents use
    return quality_crf.with_score(docs, model, score_col=score).filter(F.col(score) >= quality_crf.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each document of the mix."""
    return sentencepiece_codec.encoded(docs, piece_model(), outputs=("n_tokens", "ids"), carry=("doc_id", "source"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mix), ("SentencePiece encoding", tokens)]

#: The classifier and the join aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else settle(out, f"corpus-{k}")
    return docs
