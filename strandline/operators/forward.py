"""The reward model: parameters, and its evaluation over trajectories.

One trajectory is one row, so evaluation needs no shuffle: dense algebra runs in
NumPy over Arrow batches, a row at a time, with no padding. What follows from the
token outputs (pooling, localisation, losses) is relational.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schema import RewardConfig

TOKEN_FIELDS = ("gate_logits", "gates", "token_rewards", "hallucination_logits", "progress", "token_values", "condition_relevance", "key_prior_logits", "complete_prior_logits", "key_prior", "complete_prior", "fused_prior")
ROW_FIELDS = ("score", "token_score", "score_residual")
VECTOR_FIELDS = ("representation", "pooled", "reconstruction")

SCORED = "row_index long, query_id string, n_tokens int, " + ", ".join(f"{f} double" for f in ROW_FIELDS) + ", " + ", ".join(f"{f} array<double>" for f in (*VECTOR_FIELDS, *TOKEN_FIELDS)) + ", condition_attention array<array<double>>"


def shapes(c: RewardConfig) -> dict[str, tuple[int, ...]]:
    """Parameters and their shapes; all are linear in hidden_dim."""
    d, a, p = c.hidden_dim, c.condition_attention_dim, c.projection_dim
    fused = 4 * a + 1
    return {
        **{f"condition_{n}.weight": (a, d) for n in ("query", "key", "value", "hidden_proj")},
        "fusion_norm.weight": (fused,),
        "fusion_norm.bias": (fused,),
        "fusion_1.weight": (a, fused),
        "fusion_1.bias": (a,),
        "fusion_2.weight": (a, a),
        "fusion_2.bias": (a,),
        "delta.weight": (d, a),
        "delta.bias": (d,),
        "feature_norm.weight": (d,),
        "feature_norm.bias": (d,),
        "token_reward.weight": (2, d),
        "token_reward.bias": (2,),
        **{f"{n}.{k}": (1, d) if k == "weight" else (1,) for n in ("hallucination", "progress", "final_score", "key_prior", "complete_prior") for k in ("weight", "bias")},
        "reconstruct_1.weight": (a, d),
        "reconstruct_1.bias": (a,),
        "reconstruct_2.weight": (d, a),
        "reconstruct_2.bias": (d,),
        "project_norm.weight": (d,),
        "project_norm.bias": (d,),
        "project.weight": (p, d),
        "project.bias": (p,),
    }


def n_parameters(c: RewardConfig) -> int:
    return sum(math.prod(s) for s in shapes(c).values())


def initial(c: RewardConfig, seed: int = 0) -> dict[str, np.ndarray]:
    """Uniform weights scaled by fan-in; norms start as the identity."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes(c).items():
        if "norm" in name:
            out[name] = np.ones(shape) if name.endswith("weight") else np.zeros(shape)
        else:
            fan = shape[-1] if len(shape) > 1 else shapes(c)[name.replace("bias", "weight")][-1]
            out[name] = rng.uniform(-1, 1, shape) / math.sqrt(fan)
    return out


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * weight + bias


def unit(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), eps)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def normalized(a: np.ndarray, eps: float) -> np.ndarray:
    a = np.maximum(a, 0)
    return a / max(a.sum(), eps)


def condition(p: dict, c: RewardConfig, h: np.ndarray, cond: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, relevance and attention of one row's tokens given its condition tokens.

    Without condition tokens the features are the hidden states as they are.
    """
    if not len(cond):
        return h, np.zeros(len(h)), np.zeros((len(h), 0))
    q, k, v = unit(h @ p["condition_query.weight"].T), unit(cond @ p["condition_key.weight"].T), cond @ p["condition_value.weight"].T
    attention = softmax(q @ k.T / max(c.condition_attention_temperature, c.eps))
    attention = attention / np.maximum(attention.sum(-1, keepdims=True), c.eps)
    context, matched = attention @ v, attention @ k
    relevance = (q * matched).sum(-1)
    proj = h @ p["condition_hidden_proj.weight"].T
    fused = np.concatenate([proj, context, proj * context, proj - context, relevance[:, None]], -1)
    fused = layer_norm(fused, p["fusion_norm.weight"], p["fusion_norm.bias"])
    fused = gelu(fused @ p["fusion_1.weight"].T + p["fusion_1.bias"]) @ p["fusion_2.weight"].T + p["fusion_2.bias"]
    delta = fused @ p["delta.weight"].T + p["delta.bias"]
    return layer_norm(h + delta, p["feature_norm.weight"], p["feature_norm.bias"]), relevance, attention


def forward_row(p: dict, c: RewardConfig, h: np.ndarray, cond: np.ndarray) -> dict:
    """All outputs of the model for one trajectory."""
    if h.ndim != 2 or h.shape[1] != c.hidden_dim:
        raise ValueError(f"hidden_states must be [time, {c.hidden_dim}], not {list(h.shape)}")
    if len(cond) and cond.shape[1] != c.hidden_dim:
        raise ValueError("condition tokens must have the width of hidden_states")
    x, relevance, attention = condition(p, c, h, cond)
    head = lambda n: (x @ p[f"{n}.weight"].T + p[f"{n}.bias"])[:, 0]
    both = x @ p["token_reward.weight"].T + p["token_reward.bias"]
    gates = sigmoid(both[:, 0])
    progress = head("progress")
    values = both[:, 1] + c.progress_score_weight * progress
    token_score = (gates * values).sum() / max(gates.sum(), c.eps)
    pooled = x.mean(0)
    residual = (pooled @ p["final_score.weight"].T + p["final_score.bias"])[0]
    key_logits, complete_logits = head("key_prior"), head("complete_prior")
    key, complete = normalized(softmax(key_logits), 1e-8), normalized(softmax(complete_logits), 1e-8)
    hidden = gelu(complete @ x @ p["reconstruct_1.weight"].T + p["reconstruct_1.bias"])
    return {
        "score": token_score + residual,
        "token_score": token_score,
        "score_residual": residual,
        "representation": unit(layer_norm(pooled, p["project_norm.weight"], p["project_norm.bias"]) @ p["project.weight"].T + p["project.bias"]),
        "pooled": pooled,
        "reconstruction": hidden @ p["reconstruct_2.weight"].T + p["reconstruct_2.bias"],
        "gate_logits": both[:, 0],
        "gates": gates,
        "token_rewards": both[:, 1],
        "hallucination_logits": head("hallucination"),
        "progress": progress,
        "token_values": values,
        "condition_relevance": relevance,
        "key_prior_logits": key_logits,
        "complete_prior_logits": complete_logits,
        "key_prior": key,
        "complete_prior": complete,
        "fused_prior": normalized(c.prior_fusion_alpha * key + (1 - c.prior_fusion_alpha) * complete, c.eps),
        "condition_attention": attention,
    }


def forward(trajectories: DataFrame, params: dict[str, np.ndarray], config: RewardConfig, n_tokens: str | None = None) -> DataFrame:
    """Model outputs of every trajectory, in the columns of SCORED.

    n_tokens names a column with the number of valid tokens, if not all are. A
    row depends on nothing but itself. The parameters are broadcast: they are
    linear in hidden_dim and do not grow with the data.
    """
    shared = trajectories.sparkSession.sparkContext.broadcast((params, config))
    valid = F.col(n_tokens).cast("int") if n_tokens else F.size("hidden_states")
    rows = trajectories.select("row_index", "query_id", valid.alias("n_tokens"), "hidden_states", "condition_states", "condition_embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, c = shared.value
        for batch in batches:
            out: dict[str, list] = {f: [] for f in (*ROW_FIELDS, *VECTOR_FIELDS, *TOKEN_FIELDS, "condition_attention")}
            for n, h, states, embedding in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                parts = [*(states or []), *([embedding] if embedding is not None else [])]
                got = forward_row(p, c, np.asarray(h[:n], float), np.asarray(parts, float))
                for f in out:
                    out[f].append(got[f].tolist() if isinstance(got[f], np.ndarray) else float(got[f]))
            doubles = pa.list_(pa.float64())
            kind = {f: pa.float64() for f in ROW_FIELDS} | {f: doubles for f in (*VECTOR_FIELDS, *TOKEN_FIELDS)} | {"condition_attention": pa.list_(doubles)}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(v, kind[f]) for f, v in out.items())], names=["row_index", "query_id", "n_tokens", *out])

    return rows.mapInArrow(run, SCORED)


def token_rows(scored: DataFrame) -> DataFrame:
    """One row a token: row_index, pos, n_tokens and the token outputs."""
    zipped = F.arrays_zip(*[F.col(f) for f in TOKEN_FIELDS])
    return scored.select("row_index", "n_tokens", F.posexplode(zipped).alias("pos", "t")).select("row_index", "pos", "n_tokens", *[F.col(f"t.{f}").alias(f) for f in TOKEN_FIELDS])


def save(spark: SparkSession, params: dict[str, np.ndarray], config: RewardConfig, path: str) -> None:
    """Checkpoint: parameters as a table, the configuration as one JSON line."""
    rows = [(n, list(v.shape), v.astype(float).ravel().tolist()) for n, v in params.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
    spark.createDataFrame([(json.dumps(asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], RewardConfig]:
    config = RewardConfig(**json.loads(spark.read.text(f"{path}/config").first()[0]))
    rows = spark.read.parquet(f"{path}/params").collect()
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}, config
