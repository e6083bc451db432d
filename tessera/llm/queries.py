"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, license_scan, minhash, packing, pii, quality, rule_ledger, token_store, toxicity, url_filter
from .common import table
from .tokens import vocabulary


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_token_store(spark, sf_dir):
    folder, manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)
    return token_store.read_tokens(spark, folder, manifest)


def _bucket(n: int):
    return lambda c: F.crc32(F.col(c).cast("string")) % n


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = _bucket(5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda c: fold(c) != 0)
    scored = quality.append_scores(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = _bucket(4)
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda c: fold(c) != 2)
    scored = quality.append_scores(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, 1024)


def op9_quality_rules(spark, sf_dir):
    judged = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", *rule_ledger._NAMES, "base_failed", "kept", "failed")


def op10_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_pii, op3_token_store, op4_toxicity, op5_quality, op6_url_filter, op7_decontaminate, op8_packing, op9_quality_rules, op10_license_scan)}

ORACLE = {"op6_url_filter": url_filter.oracle()}
