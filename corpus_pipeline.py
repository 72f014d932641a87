"""From raw documents to packed training sequences: STAGES in order.

Every stage but the last returns the columns of documents; each works on all that
the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import copies, mixing, packing, quality, secrets
from strandline.llm.common import cut, drop, only, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels of docs, does not reject."""
    params = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, params).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the smallest doc_id, then the smallest hash of the text.

    Components link texts whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more: SimHash balls propose pairs, MinHash bands those that lie beyond
    every ball, and the texts decide. A row without a doc_id is kept where its component has no other.
    """
    rows, member = copies.near_copies(docs)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), "_at")
    node = rows.groupBy("_node").agg(F.min(order).alias("row"))
    first = node.join(member, "_node").groupBy("component").agg(F.min("row").alias("row"))
    return only(rows, first.select(F.col("row._at").alias("number"))).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes."""
    return mixing.emit(mixing.mix(docs.withColumn("size", mixing.n_words(F.col("text"))))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Training, hashing into components and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
            drop(before)
    return docs
