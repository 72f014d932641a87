"""Trajectories over the test tables: the engine's two loss tables, and their SQL.

``embeddings`` gives token vectors, eight to a trajectory (the last may be
shorter), four trajectories to a query, eight to a batch. Six heads with fixed
weights stand for a trained model; labels follow from row numbers, with gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import l2_normalize, linear, normalize_attention, sigmoid, softmax

DIM, PER_ROW, PER_QUERY, PER_BATCH = 64, 8, 4, 8
HEADS = ("gate_logits", "token_rewards", "hallucination_logits", "progress", "key_prior_logits", "complete_prior_logits")
PROGRESS_WEIGHT, ALPHA = 0.5, 0.5


def weights(head: int) -> list[float]:
    return [((i * (head + 3) + head * 5) % 11 - 5) / 5.0 for i in range(DIM)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a token: row_index, pos, label, embedding and the six heads."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.floor(F.col("vec_id") / PER_ROW).alias("row_index"),
        (F.col("vec_id") % PER_ROW).alias("pos"),
        "label",
        "embedding",
        *[linear("embedding", weights(k)).alias(name) for k, name in enumerate(HEADS)],
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss table of tokens."""
    raw = heads(spark, sf_dir)
    row, pos, label = F.col("row_index"), F.col("pos"), F.col("label")
    out = raw.withColumns(
        {
            "batch_id": F.floor(row / PER_BATCH),
            "gates": sigmoid("gate_logits"),
            "token_values": F.col("token_rewards") + PROGRESS_WEIGHT * F.col("progress"),
            "key_prior": softmax("key_prior_logits"),
            "complete_prior": softmax("complete_prior_logits"),
            "adv": F.when(row % 3 != 0, (label - 4) / 10.0),
            "prog": F.when(row % 4 != 1, label / 10.0),
            "key_t": F.when((row % 5 != 4) & (pos % 4 != 3), (label % 2).cast("double")),
            "comp_t": F.when(row % 6 != 5, (label % 3 == 0).cast("double")),
        }
    )
    return out.withColumn("fused_prior", normalize_attention(ALPHA * F.col("key_prior") + (1 - ALPHA) * F.col("complete_prior")))


def pooled(tokens: DataFrame) -> DataFrame:
    """row_index and the mean vector of its tokens."""
    return tokens.groupBy("row_index").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIM)]).alias("pooled"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss table of trajectories."""
    raw = heads(spark, sf_dir)
    gate = sigmoid("gate_logits")
    value = F.col("token_rewards") + PROGRESS_WEIGHT * F.col("progress")
    by_row = raw.groupBy("row_index").agg(
        F.count("*").cast("int").alias("n_tokens"),
        (F.sum(gate * value) / F.greatest(F.sum(gate), F.lit(1e-8))).alias("score"),
        F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIM)]).alias("pooled"),
        F.min_by("embedding", "pos").alias("first"),
    )
    row = F.col("row_index")
    return by_row.select(
        "row_index",
        F.floor(row / PER_BATCH).alias("batch_id"),
        F.floor(row / PER_QUERY).cast("string").alias("query_id"),
        "n_tokens",
        "score",
        l2_normalize(F.col("pooled")).alias("representation"),
        F.transform("pooled", lambda x: x * 0.5).alias("reconstruction"),
        F.when(row % 7 != 6, F.floor(row / PER_QUERY).cast("string")).alias("semantic_key"),
        F.when(row % 11 != 10, (row % 4).cast("string")).alias("style_key"),
        F.when(row % 5 != 0, (row * 7 % 3 == 1).cast("double")).alias("correctness"),
        F.when(row % 4 != 2, (row % 2).cast("double")).alias("path_hallucinated"),
        F.when(row % 3 == 2, -1).when(row % 3 == 0, (F.floor(row / 3) % 4).cast("int")).alias("hallucination_onset"),
        F.when(row % 2 == 0, F.transform("first", lambda x: x.cast("double"))).alias("complete_reconstruction_target"),
    )


def _sql_head(k: int) -> str:
    return f"list_dot_product(embedding::DOUBLE[], [{', '.join(map(str, weights(k)))}]::DOUBLE[])"


_MEANS = "[" + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE)" for i in range(DIM)) + "]"

#: Common table expressions heads, tok and rws: the tables above in SQL.
SQL = f"""WITH heads AS (
  SELECT vec_id // {PER_ROW} AS row_index, vec_id % {PER_ROW} AS pos, label, embedding,
    {", ".join(f"{_sql_head(k)} AS {name}" for k, name in enumerate(HEADS))}
  FROM embeddings
), soft AS (
  SELECT *, row_index // {PER_BATCH} AS batch_id, 1 / (1 + exp(-gate_logits)) AS gates,
    token_rewards + {PROGRESS_WEIGHT} * progress AS token_values,
    exp(key_prior_logits) / sum(exp(key_prior_logits)) OVER (PARTITION BY row_index) AS key_prior,
    exp(complete_prior_logits) / sum(exp(complete_prior_logits)) OVER (PARTITION BY row_index) AS complete_prior,
    CASE WHEN row_index % 3 <> 0 THEN (label - 4) / 10.0::DOUBLE END AS adv,
    CASE WHEN row_index % 4 <> 1 THEN label / 10.0::DOUBLE END AS prog,
    CASE WHEN row_index % 5 <> 4 AND pos % 4 <> 3 THEN (label % 2)::DOUBLE END AS key_t,
    CASE WHEN row_index % 6 <> 5 THEN (label % 3 = 0)::INT::DOUBLE END AS comp_t
  FROM heads
), tok AS (
  SELECT *, {ALPHA} * key_prior + {1 - ALPHA} * complete_prior AS fused_prior FROM soft
), by_row AS (
  SELECT row_index, count(*)::INT AS n_tokens, sum(gates * token_values) / greatest(sum(gates), 1e-8) AS score,
    {_MEANS} AS pooled, arg_min(embedding, pos) AS first
  FROM tok GROUP BY row_index
), rws AS (
  SELECT row_index, row_index // {PER_BATCH} AS batch_id, (row_index // {PER_QUERY})::VARCHAR AS query_id, n_tokens, score,
    list_transform(pooled, lambda x: x / greatest(sqrt(list_dot_product(pooled, pooled)), 1e-12)) AS representation,
    list_transform(pooled, lambda x: x * 0.5) AS reconstruction,
    CASE WHEN row_index % 7 <> 6 THEN (row_index // {PER_QUERY})::VARCHAR END AS semantic_key,
    CASE WHEN row_index % 11 <> 10 THEN (row_index % 4)::VARCHAR END AS style_key,
    CASE WHEN row_index % 5 <> 0 THEN (row_index * 7 % 3 = 1)::INT::DOUBLE END AS correctness,
    CASE WHEN row_index % 4 <> 2 THEN (row_index % 2)::DOUBLE END AS path_hallucinated,
    CASE WHEN row_index % 3 = 2 THEN -1 WHEN row_index % 3 = 0 THEN (row_index // 3) % 4 END AS hallucination_onset,
    CASE WHEN row_index % 2 = 0 THEN first::DOUBLE[] END AS complete_reconstruction_target
  FROM by_row
), lab AS (
  SELECT tok.*, hallucination_onset, path_hallucinated, hallucination_onset IS NOT NULL AS onset_known,
    coalesce(hallucination_onset >= 0 AND pos >= hallucination_onset, false) AS tail
  FROM tok JOIN rws USING (row_index)
)
"""
