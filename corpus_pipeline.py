"""From raw documents to a training mixture, in stages that are each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, fertility, gam, mixing, simhash
from marlstone.llm.common import spare, staged, table
from marlstone.llm.queries import fertility_rules, quality_model


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model calls low quality (score under 0.3) go.

    Null and empty texts are scored like any other; repeated rows go or stay
    together; an empty table stays empty. The model learns from the tables of
    documents and labels, whatever docs holds.
    """
    score = spare("_quality", docs)
    scored = gam.with_score(docs, quality_model(spark, sf_dir), out=score)
    return scored.where(F.col(score) >= 0.3).drop(score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's fertility band go.

    Null and empty texts have no words and go; a null or unknown language takes
    the band of the script; repeated rows go or stay together; an empty table
    stays empty. The bands are set by the tables of documents and labels,
    whatever docs holds.
    """
    return fertility.keep_fertile(docs, rules=fertility_rules(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest doc_id.

    Null and empty texts are one group. Repeated rows are copies; ids with
    several texts stay once for each group that they head. Rows with a null
    id stay. An empty table stays empty.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and null ids stay; all rows of an id go together;
    without items, or without documents, nothing changes.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents that are left, towards the target weights of their sources.

    A null source is a source, a null id is drawn as the empty text, repeated
    rows draw alike; an empty table gives an empty mixture.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Trained models and tokenizers cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
