"""The registered queries of these operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, htmltext, licenses, mixing, neardup, phrases, quality, runs, subwords, tokens, toxicity, warc
from .common import scratch, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = scratch(spark, "tokens")
    tokens.write_token_files(table(spark, sf_dir, "documents"), dest, vocabulary("byte_bpe_50k.json"))
    return tokens.read_token_files(spark, dest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), fingerprint.packed(own).alias("fingerprint"), fingerprint.packed(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(own, edited).alias("near_edited"), fingerprint.resemblance(own, following).alias("near_next"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.learnable(F.col("doc_id"))))
    done = toxicity.scored(docs.select("doc_id", "text"), model, evidence=False)
    return done.select("doc_id", F.coalesce(~toxicity.learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "word_log_perplexity")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), dest, date=warc.now())
    return warc.read_archives(spark, dest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = subwords.fit(docs, labels.filter(subwords.learnable(F.col("doc_id"))))
    done = subwords.scored(docs.select("doc_id", "text"), model)
    return done.select("doc_id", F.coalesce(~subwords.learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = runs.with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), planted=True)
    return done.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op5_licenses": licenses.sql(), "op10_near_duplicates": neardup.SQL, "op12_phrases": phrases.SQL}
