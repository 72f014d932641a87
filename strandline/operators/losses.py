"""Losses of the reward model as aggregates by batch.

Two tables carry everything. ``rows`` has one row a trajectory: batch_id,
row_index, n_tokens, score, representation, reconstruction and the row's labels,
null where there is none. ``tokens`` has one row a token: batch_id, row_index, pos,
the token outputs and the token's labels adv, prog, key_t and comp_t. A label that
no row of a batch has switches its loss off for that batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import CLAMP, bce, bce_with_logits, dot, mean_or_zero, normalize_attention, sigmoid, squared_error
from strandline.schema import METRICS, Phase, RewardConfig

ROW_LABELS = ("hallucination_onset", "path_hallucinated")


def check_onsets(rows: DataFrame) -> DataFrame:
    """rows; evaluation fails if a labelled onset lies beyond its row's valid tokens."""
    bad = F.col("hallucination_onset") >= F.col("n_tokens")
    said = F.concat(F.lit("hallucination_onset is outside the valid tokens of row "), F.col("row_index"))
    return rows.withColumn("hallucination_onset", F.when(bad, F.raise_error(said).cast("int")).otherwise(F.col("hallucination_onset")))


def final_term() -> Column:
    """Cross-entropy of the score; a missing correctness counts as 0 where another row has one."""
    return F.when(F.bool_or(F.col("correctness").isNotNull()), F.avg(bce_with_logits("score", F.coalesce("correctness", F.lit(0.0))))).otherwise(F.lit(0.0)).alias("final")


def labelled_tokens(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens with their row's labels, the tail flag and what their batch has."""
    labels = rows.select("row_index", *ROW_LABELS)
    onset = F.col("hallucination_onset")
    joined = tokens.join(labels, "row_index")
    return joined.withColumns({"tail": F.coalesce((onset >= 0) & (F.col("pos") >= onset), F.lit(False)), "onset_known": onset.isNotNull()})


def prepared(labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """labelled tokens with what losses need of their whole row.

    All of it comes from windows over one key, so one shuffle serves every token
    loss: gate_mass, the row's first crossing, its path probability, and whether
    the token is its row's first, to count the row once.
    """
    w = Window.partitionBy("row_index")
    p = F.greatest(F.least(sigmoid("hallucination_logits"), F.lit(1 - CLAMP)), F.lit(CLAMP))
    return labelled.withColumns(
        {
            "gate_mass": normalize_attention("gates"),
            "crossing": F.min(F.when(sigmoid("hallucination_logits") >= threshold, F.col("pos"))).over(w),
            "path_p": 1 - F.exp(F.sum(F.ln(1 - p)).over(w)),
            "leads": F.col("pos") == F.min("pos").over(w),
        }
    )


def localization_terms(margin: float) -> list[Column]:
    """token_bce, token_reward and tail_margin; none where no row of the batch has an onset label."""
    tail, value = F.col("tail"), F.col("token_values")
    target = F.when(tail, F.lit(-margin)).otherwise(F.coalesce("adv", F.lit(0.0)))
    off = lambda c: F.when(F.bool_or("onset_known"), c).otherwise(F.lit(0.0))
    short = F.greatest(value + margin, F.lit(0.0))
    return [
        off(mean_or_zero(bce_with_logits("hallucination_logits", tail), F.col("onset_known"))).alias("localization_token_bce"),
        off(mean_or_zero(squared_error(value, target), F.col("adv").isNotNull() | tail)).alias("localization_token_reward"),
        off(mean_or_zero(short * short, tail)).alias("localization_tail_margin"),
    ]


def mil_term() -> Column:
    """Cross-entropy of the chance that any token is hallucinated, over labelled rows."""
    return mean_or_zero(bce("path_p", "path_hallucinated"), F.col("leads") & F.col("path_hallucinated").isNotNull()).alias("hallucination_mil")


def pseudo_tail_term(margin: float) -> Column:
    """Hinge on tokens from the first crossing on, in positive rows without an onset label."""
    weak = F.coalesce(F.col("path_hallucinated") != 0, F.lit(False)) & ~F.col("onset_known")
    short = F.greatest(F.col("token_values") + margin, F.lit(0.0))
    return mean_or_zero(short * short, weak & F.coalesce(F.col("pos") >= F.col("crossing"), F.lit(False))).alias("pseudo_tail")


def progress_term() -> Column:
    return mean_or_zero(squared_error("progress", "prog"), F.col("prog").isNotNull()).alias("progress")


def prior_terms(phase: str = "joint") -> list[Column]:
    """The four token terms of the priors; those of other phases are 0.

    Distillation and the gate term compare attention mass on tokens that both
    priors label, without scaling it anew, and need both labels in the batch.
    """
    p, zero = Phase(phase), F.lit(0.0)
    key, complete = F.col("key_t").isNotNull(), F.col("comp_t").isNotNull()
    both = lambda c: F.when(F.bool_or(key) & F.bool_or(complete), c).otherwise(zero)
    return [
        (mean_or_zero(bce_with_logits("key_prior_logits", "key_t"), key) if p.key else zero).alias("prior_key"),
        (mean_or_zero(bce_with_logits("complete_prior_logits", "comp_t"), complete) if p.complete else zero).alias("prior_complete"),
        both(p.distill * mean_or_zero(squared_error("key_prior", "complete_prior"), key & complete)).alias("prior_distill"),
        both(mean_or_zero(squared_error("gate_mass", "fused_prior"), key & complete)).alias("prior_gate"),
    ]


def reconstruction_loss(rows: DataFrame) -> DataFrame:
    """Mean squared error over the dimensions of rows with a target, by batch."""
    wanted = rows.where("complete_reconstruction_target is not null").select("batch_id", F.explode(F.arrays_zip(F.col("reconstruction").alias("a"), F.col("complete_reconstruction_target").alias("b"))).alias("d"))
    return wanted.groupBy("batch_id").agg(F.avg(squared_error("d.a", "d.b")).alias("prior_reconstruction"))


def with_prior_total(terms: DataFrame, rows: DataFrame, config: RewardConfig, phase: str) -> DataFrame:
    """terms by batch with prior_reconstruction and prior_total."""
    if Phase(phase).complete:
        terms = terms.join(reconstruction_loss(rows), "batch_id", "left").na.fill({"prior_reconstruction": 0.0})
    else:
        terms = terms.withColumn("prior_reconstruction", F.lit(0.0))
    total = config.key_prior_weight * F.col("prior_key") + config.complete_prior_weight * F.col("prior_complete") + config.prior_distill_weight * F.col("prior_distill") + config.gate_prior_weight * F.col("prior_gate") + config.reconstruction_weight * F.col("prior_reconstruction")
    return terms.withColumn("prior_total", total)


def prior_losses(rows: DataFrame, tokens: DataFrame, config: RewardConfig, phase: str = "joint") -> DataFrame:
    """The five prior terms and their total, by batch."""
    terms = tokens.withColumn("gate_mass", normalize_attention("gates")).groupBy("batch_id").agg(*prior_terms(phase))
    return with_prior_total(terms, rows, config, phase)


def token_losses(tokens: DataFrame, *terms: Column) -> DataFrame:
    return tokens.groupBy("batch_id").agg(*terms)


def pairs(rows: DataFrame, same: str, other: str, columns: list[str]) -> DataFrame:
    """Pairs i < j of a batch that agree on one key and differ on the other.

    An equi-join; the batch is part of the key, so a key common to a third of
    all rows meets itself only within a batch.
    """
    eligible = rows.where(F.col("semantic_key").isNotNull() & F.col("style_key").isNotNull())
    side = lambda s: eligible.select("batch_id", same, F.col(other).alias(f"{other}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ["row_index", *columns]])
    return side("i").join(side("j"), ["batch_id", same]).where((F.col("row_index_i") < F.col("row_index_j")) & (F.col(f"{other}_i") != F.col(f"{other}_j")))


def consistency_losses(rows: DataFrame, config: RewardConfig) -> DataFrame:
    """Rewrites of one question agree in representation and score, and same-styled others do not."""
    near = dot(F.col("representation_i"), F.col("representation_j"))
    alike = pairs(rows, "semantic_key", "style_key", ["representation", "score"]).groupBy("batch_id").agg(F.avg(1 - near).alias("consistency_positive"), F.avg(squared_error("score_i", "score_j")).alias("consistency_score"))
    apart = F.greatest(near - config.consistency_margin, F.lit(0.0))
    unlike = pairs(rows, "style_key", "semantic_key", ["representation"]).groupBy("batch_id").agg(F.avg(apart).alias("consistency_negative"))
    out = rows.select("batch_id").distinct().join(alike, "batch_id", "left").join(unlike, "batch_id", "left").na.fill(0.0)
    return out.withColumn("consistency_total", F.col("consistency_positive") + F.col("consistency_negative") + config.score_consistency_weight * F.col("consistency_score"))


def losses(rows: DataFrame, tokens: DataFrame, config: RewardConfig, phase: str = "joint") -> DataFrame:
    """One row a batch: batch_id, batch_size and all METRICS; a loss that is off is 0."""
    rows = check_onsets(rows)
    seen = prepared(labelled_tokens(rows, tokens), config.pseudo_onset_threshold)
    by_token = token_losses(seen, *localization_terms(config.negative_tail_margin), mil_term(), pseudo_tail_term(config.negative_tail_margin), progress_term(), *prior_terms(phase))
    out = rows.groupBy("batch_id").agg(F.count("*").alias("batch_size"), final_term())
    for part in (consistency_losses(rows, config), with_prior_total(by_token, rows, config, phase)):
        out = out.join(part, "batch_id", "left")
    out = out.na.fill(0.0)
    weight = {
        "final": config.final_weight,
        "consistency_total": config.consistency_weight,
        "localization_token_bce": config.hallucination_weight,
        "localization_token_reward": config.token_reward_weight,
        "localization_tail_margin": config.tail_weight,
        "hallucination_mil": config.mil_weight,
        "pseudo_tail": config.pseudo_tail_weight,
        "progress": config.progress_weight,
        "prior_total": config.prior_weight,
    }
    return out.withColumn("total", sum((w * F.col(m) for m, w in weight.items()), F.lit(0.0))).select("batch_id", "batch_size", *METRICS)


def epoch_means(by_batch: DataFrame, metrics=METRICS) -> DataFrame:
    """Means over an epoch, each batch weighing its size, for every metric."""
    n = F.greatest(F.sum("batch_size"), F.lit(1))
    return by_batch.agg(*[(F.sum(F.col(m) * F.col("batch_size")) / n).alias(m) for m in metrics])
