"""The queries of the numbered operators, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import alignment, audit, bpe, ctw, decontaminate, fertility, gam, mixing, ppm, simhash, toolcalls, toxicity, warc
from .common import fold, shared_dir, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fertility_rules(spark: SparkSession, sf_dir: str) -> fertility.Rules:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fertility.fit(docs, labels.where(fold("doc_id", 5) != 0))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fertility.with_fitted(docs, labels.where(fold("doc_id", 5) != 0)).select("doc_id", "fertility.*")


def quality_model(spark: SparkSession, sf_dir: str) -> gam.Gam:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return gam.fit(docs, labels.where(fold("doc_id", 5) != 0), "quality")


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gam.with_score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    scored = toxicity.with_toxicity(docs, model, out="score")
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op8_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, "record_id string, warc_type string, payload_digest string, refers_to string, payload_bytes long")
    page = lambda c: F.regexp_extract(c, "urn:x-page:(-?[0-9]+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return found.where(F.col("warc_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


def op9_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = ppm.with_language(docs, ppm.fit(docs.where(fold("doc_id", 3) != 1)))
    return told.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score", "language.bits")


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(*toolcalls.from_conversations(spark, table(spark, sf_dir, "conversations")))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.text_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.audit(rows, {x: F.col(x) for x in "ABCDE"}, F.col("part"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_benchmark_decontamination, op2_tokeniser_fertility, op3_quality_gam, op4_poisson_mixing,
        op5_noisy_channel_toxicity, op6_context_tree_weighting,
        op7_simhash_near_dedup, op8_warc_source, op9_ppm_language_id, op10_tool_call_linking,
        op11_filter_interaction, op12_tokenizer_alignment, op13_byte_bpe,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op4_poisson_mixing": mixing.oracle(), "op11_filter_interaction": audit.oracle()}
