"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, conversations, dac, fingerprint, langid, licenses, mixing, near_dup, phrases, pu_quality, quality, repeats, secrets
from lectern.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.fit(docs), reject=False)


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_digests(dac.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("host")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), alive=F.col("alive"))
    return found.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pu_quality.score(docs, pu_quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_repeats, op3_license_scan, op4_token_binary, op5_winnowing, op6_secret_scan, op7_byte_bpe, op8_quality_rules, op9_minhash_near_dedup, op10_source_mix, op11_conversation_repair, op12_phrase_mining, op13_quality_classifier)}
