"""Best-of-N and the scores reported for each trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import first_crossing, let, noisy_or
from strandline.scratch import cut


def best_of_n(scored: DataFrame, group: str = "query_id", score: str = "score", row: str = "row_index", flag: str = "selected") -> DataFrame:
    """scored and a flag on the best row of each group.

    The first row of the highest score wins. A NaN is never better than another
    score, and one that comes first is never beaten. The winner comes from a
    partially aggregated maximum, so a large group is not held by one task.
    """
    value = F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score))
    leading = F.min_by(F.isnan(score), row)
    winners = scored.groupBy(group).agg(F.when(leading, F.min(row)).otherwise(F.max_by(row, F.struct(value, -F.col(row)))).alias("_winner"))
    joined = scored.join(winners.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*scored.columns, (F.col(row) == F.col("_winner")).alias(flag))


def winners(scored: DataFrame, group: str = "query_id", score: str = "score", row: str = "row_index") -> DataFrame:
    """Only the best row of each group, where no score is NaN."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(row))
    return scored.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def score_report(scored: DataFrame, onset_threshold: float = 0.5) -> DataFrame:
    """The ten clir_* fields of every trajectory, and row_index and query_id."""
    # Three parts of the plan read the model's outputs; they are worked out once.
    scored = cut(scored.select("row_index", "query_id", "score", "hallucination_logits", "gates", "fused_prior", "condition_relevance", "key_prior", "complete_prior"), "scored")
    tokens = scored.select("row_index", F.posexplode(F.arrays_zip("hallucination_logits", "gates", "fused_prior")).alias("pos", "t"))
    per_row = tokens.groupBy("row_index").agg(
        noisy_or("t.hallucination_logits").alias("clir_path_hallucination_prob"),
        first_crossing("t.hallucination_logits", "pos", onset_threshold).alias("clir_pseudo_onset"),
        F.avg("t.gates").alias("clir_mean_gate"),
        (F.sum(F.col("t.gates") * F.col("t.fused_prior")) / F.greatest(F.sum("t.gates"), F.lit(1e-8))).alias("clir_prior_gate_alignment"),
    )
    flagged = best_of_n(scored.select("row_index", "query_id", "score", "condition_relevance", "gates", "key_prior", "complete_prior"), flag="clir_selected_best_of_n")
    gate_mass = F.greatest(F.aggregate("gates", F.lit(0.0), lambda s, g: s + g), F.lit(1e-8))
    return flagged.join(per_row, "row_index").select(
        "row_index",
        "query_id",
        F.col("score").alias("clir_score"),
        "clir_path_hallucination_prob",
        "clir_pseudo_onset",
        "clir_mean_gate",
        "clir_prior_gate_alignment",
        F.col("condition_relevance").alias("clir_condition_relevance"),
        let(gate_mass, lambda m: F.transform("gates", lambda g: g / m)).alias("clir_gate_attention"),
        F.col("key_prior").alias("clir_key_prior"),
        F.col("complete_prior").alias("clir_complete_prior"),
        "clir_selected_best_of_n",
    )
