"""Cleans the documents in stages, each on what its predecessor kept.

Toxic documents go, one document of each group of near duplicates stays, documents that hold a
benchmark passage go, personal data is masked, and the rest is encoded. A stage works on all rows it is
given; null and empty texts pass all filters and encode to no ids. Rows that repeat both id and text
become one in the near-duplicate stage.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitlens.llm import bpe, decontaminate, ngram_join, pii, toxicity
from hitlens.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by a lexicon learned from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_rows(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id in each group linked by the n-gram join, null ids last.

    Rows are told apart by id and text, so that ids may repeat or be null.
    """
    rows = docs.withColumn("_row", F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("text")))
    groups = ngram_join.similarity_components(rows, id_col="_row")
    kept = groups.where(F.col("_row").eqNullSafe(F.col("component_id"))).select(
        F.col("_row").alias("_kept")).distinct()
    return rows.join(kept, F.col("_row").eqNullSafe(F.col("_kept"))).drop("_kept").dropDuplicates(
        ["_row"]).drop("_row")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even an edited one."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, and ``n_chars`` to match."""
    out = pii.masked(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast("long"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every kept document, with their digests."""
    rows = docs.select(F.struct("doc_id", "source", "lang").alias("row"), "text")
    return bpe.encode_documents(rows, id_col="row", digests=True).select(
        "row.*", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("ngram_join", keep_one_of_each_group),
          ("decontamination", drop_benchmark), ("pii", mask_personal_data), ("bpe", encode)]

# The stages learn, join by similarity and encode, which SQL can't express: tests hold each
# stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
