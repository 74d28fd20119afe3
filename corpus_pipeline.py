"""From raw documents to shuffled shards: quality, near-duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, mixing, near_dedup, quality, sharding
from folioscope.llm.common import free_name, quoted, stored
from folioscope.llm.queries import DOMAINS, domain_labels, table

#: Documents whose score is lower are rejected.
LEAST_SCORE = 0.3
#: Documents that no text near them repeats less than this are copies, in per cent.
NEAR_PERCENT = 80
#: Tokens of the mixture, for each token that comes in.
MIX_TOKENS = 1.25
#: Bound of the rates inside the fit: few documents are not repeated for ever, and the fit does what it can within that.
MOST_RATE = 4.0
#: Documents whose posterior clean leads all stay; of others as many as the targets leave room for.
LEAST_RATES = {"clean": 1.0}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from labelled documents of this stage's input."""
    labels = table(spark, sf_dir, "labels")
    texts = docs.select("doc_id", "text")
    positives = texts.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    unlabelled = texts.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    model, _ = quality.fit_quality(positives, unlabelled)
    score = free_name(docs, "score")
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= LEAST_SCORE).select(*quoted(docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.near_dedup(docs, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark's words."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or left out by their rates: the domains' expected tokens meet their targets as nearly, by least squares, as
    rates of 1 to MOST_RATE for clean documents, and of 0 to MOST_RATE for others, allow."""
    labelled = domain_labels(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, DOMAINS, total_factor=MIX_TOKENS, least_rate=LEAST_RATES, most_rate=MOST_RATE)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in eight shards of a random order: shard and slot."""
    return sharding.shard(docs, 8)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learning, sampling and shuffling have no SQL; tests/llm/test_pipeline.py holds each stage and the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what the last one wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
