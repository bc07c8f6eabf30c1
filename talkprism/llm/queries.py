"""The queries of the corpus operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprism.llm import decontam, exact_dedup, html_text, lm_scoring, merkle, mixing, pii, prefix_trie, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup
from talkprism.llm.common import table
from talkprism.llm.oracle import ORACLE_SQL as ORACLE_SQL


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.with_spans(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["rank"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")], F.sha2(secret_scan.spans_text(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.main_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("repetition")
    rows = quality_rules.with_repetition(docs).select("doc_id", "repetition")
    return rows.select("doc_id", *[q[c].alias(c) for c in quality_rules.STATS], quality_rules.base_failed(q).alias("base_failed"), quality_rules.verdict(q).alias("kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.col("pseudonymised")
    rows = pii.with_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", new["text"].alias("text"), *[new[f"n_{k}"].alias(f"n_{k}") for k in pii.KINDS])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan,
    op2_substring_dedup,
    op3_html_text,
    op4_quality_classifier,
    op5_quality_rules,
    op6_simhash,
    op7_decontamination,
    op8_mixing,
    op9_lm_scoring,
    op10_pii,
    op11_prefix_trie,
    op12_exact_dedup,
    op13_merkle_manifest,
)}
