"""Schemas of the engine's tables, and the names that input fields go by."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Names of each logical field; the first that is present wins,
#: even if its value is null.
ALIASES: dict[str, tuple[str, ...]] = {
    "query_id": ("query_id", "candidate_group_id", "prompt_id"),
    "correctness": ("correctness", "label", "final_correct"),
    "semantic_id": ("semantic_id", "semantic_ids", "augmentation_group", "augmentation_group_id", "group_id"),
    "style_id": ("style_id", "style_ids", "augmentation_style", "rewrite_style", "domain_id", "domain", "style"),
    "hallucination_onset": ("hallucination_onset", "hallucination_start", "onset"),
    "path_hallucinated": ("path_hallucinated", "hallucinated", "hallucination"),
    "token_advantage": ("token_advantage", "token_advantages", "advantages"),
    "progress_targets": ("progress_targets", "progress", "progress_target"),
    "key_prior_target": ("key_prior_target", "key_prior"),
    "complete_prior_target": ("complete_prior_target", "complete_prior"),
    "complete_reconstruction_target": ("complete_reconstruction_target", "csr_target"),
}
SCALARS = ("correctness", "path_hallucinated")
SEQUENCES = ("token_advantage", "progress_targets", "key_prior_target", "complete_prior_target")
TENSORS = ("hidden_states", "condition_states", "condition_embedding")

TRAJECTORIES = (
    "row_index long, id string, query_id string, semantic_key string, style_key string, "
    "hidden_states array<array<float>>, condition_states array<array<float>>, condition_embedding array<float>, "
    "correctness double, path_hallucinated double, hallucination_onset int, "
    "token_advantage array<float>, progress_targets array<float>, key_prior_target array<float>, complete_prior_target array<float>, "
    "complete_reconstruction_target array<float>, raw string"
)


@dataclass(frozen=True)
class RewardConfig:
    """Sizes, thresholds and weights of the reward model and its objective."""

    hidden_dim: int
    projection_dim: int = 256
    condition_attention_dim: int = 256
    consistency_margin: float = 0.2
    negative_tail_margin: float = 0.5
    pseudo_onset_threshold: float = 0.5
    prior_fusion_alpha: float = 0.5
    condition_attention_temperature: float = 1.0
    progress_score_weight: float = 0.5
    eps: float = 1e-8
    final_weight: float = 1.0
    consistency_weight: float = 1.0
    score_consistency_weight: float = 0.1
    hallucination_weight: float = 1.0
    mil_weight: float = 0.25
    token_reward_weight: float = 0.5
    tail_weight: float = 0.5
    pseudo_tail_weight: float = 0.1
    progress_weight: float = 0.25
    prior_weight: float = 0.25
    key_prior_weight: float = 1.0
    complete_prior_weight: float = 1.0
    prior_distill_weight: float = 0.25
    gate_prior_weight: float = 0.25
    reconstruction_weight: float = 0.1


#: Losses by name, in the order in which they are reported.
METRICS = (
    "final",
    "consistency_positive",
    "consistency_negative",
    "consistency_score",
    "consistency_total",
    "localization_token_bce",
    "localization_token_reward",
    "localization_tail_margin",
    "hallucination_mil",
    "pseudo_tail",
    "progress",
    "prior_key",
    "prior_complete",
    "prior_distill",
    "prior_gate",
    "prior_reconstruction",
    "prior_total",
    "total",
)


@dataclass
class Phase:
    """Which prior terms a training phase has; distill counts its directions."""

    name: str
    key: bool = field(init=False)
    complete: bool = field(init=False)
    distill: int = field(init=False)

    def __post_init__(self) -> None:
        if self.name not in ("joint", "key", "complete"):
            raise ValueError(f"unknown prior phase {self.name!r}")
        self.key = self.name != "complete"
        self.complete = self.name != "key"
        self.distill = self.key + self.complete
