"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by
surface features (kinds of bytes, word lengths, words that come again soon) and a
learned layer; gated attention weights, learned from document labels alone, pool
the passages; the pooled representation is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import plus, small_batches, table
from strandline.llm.repeats import Words, _steps

PASSAGE = 64
#: Labelled documents to learn from, at most: those with the smallest hashes.
SAMPLE = 8000
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY, SEED = 60, 0.01, 1e-4, 5
THRESHOLD = 0.3
#: How far back a word is looked for.
BACK = 8

_KINDS = 9


def _kinds() -> np.ndarray:
    """Kind of each byte: small letter, capital, digit, sentence mark, bang, bar, symbol, beyond ASCII, other."""
    kind = np.full(256, 8, "i1")
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()?-", "!", "|", "#$%&*@<>=+_/\\~^`{}[]")):
        kind[[ord(c) for c in chars]] = k
    kind[128:] = 7
    return kind


_KIND = _kinds()
N_FEATURES = 3 * _KINDS + 12


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each text (and one more).

    A text without words is one passage of zeros and a mark.
    """
    words = Words(texts)
    n_words = np.diff(words.first)
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_text)])
    out = np.zeros((first[-1], N_FEATURES))
    out[first[:-1][n_words == 0], -1] = 1
    if not len(words.starts):
        return out, first
    passage = first[words.text] + words.place // PASSAGE
    cut = np.flatnonzero(np.diff(passage, prepend=-1))
    at = passage[cut]
    count = np.diff(np.append(cut, len(passage))).astype(float)
    length = (words.ends - words.starts).astype(float)
    kind = _KIND[words.raw]
    total = np.maximum(np.add.reduceat(length, cut), 1)
    for k in range(_KINDS):
        seen = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind == k, out=seen[1:])
        inside = seen[words.ends] - seen[words.starts]
        out[at, k] = np.add.reduceat(inside, cut) / total
        out[at, _KINDS + k] = np.add.reduceat((inside > 0).astype(float), cut) / count
        out[at, 2 * _KINDS + k] = np.add.reduceat((inside == length).astype(float), cut) / count
    c = 3 * _KINDS
    mean = np.add.reduceat(length, cut) / count
    out[at, c] = np.minimum(mean, 40) / 10
    out[at, c + 1] = np.minimum(np.sqrt(np.maximum(np.add.reduceat(length**2, cut) / count - mean**2, 0)), 40) / 10
    out[at, c + 2] = np.add.reduceat((length > 15).astype(float), cut) / count
    out[at, c + 3] = np.add.reduceat((length <= 2).astype(float), cut) / count
    again = np.zeros(len(length), bool)
    for lag in range(1, BACK + 1):
        same = np.zeros(len(length), bool)
        same[lag:] = (words.hash[lag:] == words.hash[:-lag]) & (words.text[lag:] == words.text[:-lag])
        again |= same
        if lag in (1, 2, 4, 8):
            out[at, c + 3 + {1: 1, 2: 2, 4: 3, 8: 4}[lag]] = np.add.reduceat(again.astype(float), cut) / count
    out[at, c + 8] = np.log1p(count) / 4
    out[at, c + 9] = np.log1p(n_words[words.text[cut]]) / 8
    out[at, c + 10] = count < 8
    return out, first


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(params: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Scores of bags, and what the gradient needs. first: first row of each bag and one more."""
    h = np.tanh(((x - params["mean"]) / params["std"]) @ params["W"] + params["b"])
    v, u = np.tanh(h @ params["V"]), _sigmoid(h @ params["U"])
    e = (v * u) @ params["w"]
    start, bag = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, start)[bag])
    a = e / np.add.reduceat(e, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start)
    return {"score": _sigmoid(z @ params["c"] + params["d"]), "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Parameters learned from bags and their 0/1 labels by Adam; the same for the same rows.

    Without labels of both kinds the score is the share of ones.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    params = {"mean": x.mean(0) if len(x) else np.zeros(d), "std": x.std(0) + 0.02 if len(x) else np.ones(d)}
    params |= {"W": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    share = (y.sum() + 1) / (len(y) + 2)
    params["d"][:] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return params
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    m, s, t = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    lengths = np.diff(first)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 256)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            starts = np.concatenate([[0], np.cumsum(lengths[part])])
            xb = x[rows]
            o = forward(params, xb, starts)
            g = (o["score"] - y[part]) / len(part)
            bag, a, h, v, u = o["bag"], o["a"], o["h"], o["v"], o["u"]
            dz = g[:, None] * params["c"]
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, starts[:-1])[bag])
            dv, du = de[:, None] * params["w"] * u * (1 - v**2), de[:, None] * params["w"] * v * u * (1 - u)
            dh = (a[:, None] * dz[bag] + dv @ params["V"].T + du @ params["U"].T) * (1 - h**2)
            grad = {"c": o["z"].T @ g, "d": g.sum(keepdims=True), "w": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": ((xb - params["mean"]) / params["std"]).T @ dh, "b": dh.sum(0)}
            t += 1
            for k in learned:
                step = grad[k] + DECAY * params[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * step, 0.999 * s[k] + 0.001 * step**2
                params[k] = params[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return params


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> dict:
    """Parameters learned from at most ``sample`` labelled documents that are not held out.

    Rows without a label, or whose label has no document, teach nothing; of
    several labels of one document the smallest counts.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(target).alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "text")

    def run(batches):
        for (ids, marks), texts in _steps(batches):
            x, first = features(texts)
            yield pa.RecordBatch.from_arrays([ids, marks.cast(pa.float64()), pa.ListArray.from_arrays(pa.array(first * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["doc_id", "label", "x"])

    found = bags.mapInArrow(run, "doc_id long, label double, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = found.column("x").combine_chunks()
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False) // N_FEATURES)]).astype(int)
    # As they lie in Arrow: a Python number for each would take the driver four times the memory.
    return fit(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES), first, found.column("label").to_numpy() > 0)


def score(docs: DataFrame, params: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if not given), and score.

    Null and empty texts are scored as empty. A column ``score`` of docs is
    replaced; ``_text`` is taken.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(params)
    names = [c for c in (keep or docs.columns) if c != "score"]

    def run(batches):
        for cols, texts in _steps(batches):
            x, first = features(texts)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(forward(shared.value, x, first)["score"])], names=[*names, "score"])

    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, plus(docs.select(*names).schema, "score double"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    params = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, params, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
