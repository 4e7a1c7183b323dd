"""A training corpus from documents: toxicity, quality rules, near-duplicates, source mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; between stages the rows are written as
Parquet and read again. All but the last return the columns of documents. Nulls, empty texts, repeated rows and empty
tables are handled as the operators say; rows that a stage keeps are unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, neardup, quality, toxicity
from plumbline.llm.common import stored, table
from plumbline.llm.queries import vocabulary


def _apart(docs: DataFrame, names: list[str], step) -> DataFrame:
    """step(docs) with columns of docs that have one of the names kept under other names meanwhile; the columns of docs."""
    own = {c: f"__own_{c}" for c in docs.columns if c in names}
    return step(docs.withColumnsRenamed(own)).withColumnsRenamed({c: f"__step_{c}" for c in own}).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Learns from the labels of these documents, but for those held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(toxicity.learnable(F.col("doc_id"))))
    return _apart(docs, ["score", "predicted", "evidence"], lambda df: toxicity.scored(df, model, evidence=False).filter("predicted = 0"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands keep."""
    return _apart(docs, quality.MADE, lambda df: quality.judged(df).filter("kept"))


def _least(docs: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key the one of smallest hashed columns, so that reruns agree; columns as in docs, without the key."""
    own = [c for c in docs.columns if not c.startswith("__")]
    return docs.groupBy(key).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("__row")).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of likeness 0.8 or more: that of its smallest doc_id; of rows that share a doc_id, one. Rows without
    doc_id go if their shingles equal those of a row that has one; of those that equal each other, one stays."""
    found = neardup.near_duplicates(docs, percent=80, keys=True)
    found = stored(found.groupBy("doc_id", "text_key").agg(F.max("kept").alias("__kept"), F.max("component_id").alias("__component"), F.max("set_key").alias("__set")).withColumnsRenamed({"doc_id": "__id", "text_key": "__text"}), "near-duplicates")
    named = docs.withColumn("__doc", F.col("doc_id").cast("long"))
    kept = named.join(found.filter("__kept AND __id IS NOT NULL").select("__id").distinct(), F.col("__doc") == F.col("__id"), "left_semi")
    repeated = docs.groupBy(F.col("doc_id").alias("__doc")).agg(F.count("*").alias("__n")).filter("__n > 1 AND __doc IS NOT NULL").select("__doc")
    several = _least(kept.join(repeated, "__doc", "left_semi"), "__doc")
    single = kept.join(repeated, "__doc", "left_anti").select(*docs.columns)
    bare = docs.filter("doc_id IS NULL").withColumn("__text", F.xxhash64("text"))
    bare = bare.join(found.filter("__id IS NULL AND __component IS NULL").select("__text", "__set"), "__text")
    empty, full = bare.filter("__set IS NULL"), bare.filter("__set IS NOT NULL")  # without words: linked with nothing
    return single.unionByName(several.select(*docs.columns)).unionByName(empty.select(*docs.columns)).unionByName(_least(full.drop("__text"), "__set").select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, and the digest of the text that they decode to."""
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("byte_bpe", encode_bytes)]

#: The first stage, nearest neighbours with learned terms, has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
