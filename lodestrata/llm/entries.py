"""The training-data queries that ``__spark_entry__`` registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bytebpe, collocations, decontaminate, langid, licences, linededup, merkle, neardup, pagetext, quality, repair, topk, toxicity
from lodestrata.llm.common import ascii_lower, is_fold, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs)
    return found.select("doc_id", is_fold(F.col("doc_id"), 4, 2).alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", is_fold(F.col("doc_id"), 4, 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", neardup.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs, labels)
    return found.select("doc_id", is_fold(F.col("doc_id"), 5, 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaves = docs.select("lang", "doc_id", merkle.leaf().alias("leaf"), F.when(is_fold(F.col("doc_id"), 3, 0), merkle.leaf(text=ascii_lower(F.col("text")))).alias("tampered"))
    found = merkle.manifest(leaves, "tampered").withColumn("folded_root", merkle.folded(F.col("path"), F.coalesce("tampered", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_byte_bpe, op3_language, op4_top_k, op5_page_text, op6_toxicity, op7_licences, op8_token_files, op9_near_duplicates, op10_quality, op11_merkle_manifest, op12_line_dedup, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontaminate.oracle(), "op4_top_k": topk.oracle(), "op7_licences": licences.oracle(), "op11_merkle_manifest": merkle.oracle(), "op12_line_dedup": linededup.oracle(), "op13_collocations": collocations.oracle()}
