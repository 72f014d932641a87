"""Ingest, batch plans, selection, losses and the model on small fixtures."""

import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as q
from strandline.operators import batching, forward, labels, losses, selection
from strandline.plans import score as score_plan
from strandline.plans import train as train_plan
from strandline.schema import METRICS, Phase, RewardConfig
from strandline.sources import sinks, trajectories
from strandline.streaming.best_of_n import streaming_best_of_n


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def read(spark, tmp_path, lines, **options):
    rows = trajectories.read_trajectories(spark, write(tmp_path / "rows.jsonl", lines), **options)
    return sorted(rows.collect(), key=lambda r: r.row_index)


# Ingest

H = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]


def test_lines_of_white_space_are_blank(spark, tmp_path):
    """All white space of str.strip() counts, so later rows keep their row_index."""
    lines = ["{}", "\t", " \x0b\x1f ", "\u00a0\u3000", '{"a": 1}', "", "x"]
    (tmp_path / "rows.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = sorted((r.row_index, r.line_no, r.value) for r in trajectories.read_lines(spark, str(tmp_path / "rows.jsonl")).collect())
    kept = [(n + 1, x) for n, x in enumerate(lines) if x.strip()]
    assert got == [(k, n, x) for k, (n, x) in enumerate(kept)]


def test_blank_lines_ids_and_aliases(spark, tmp_path):
    lines = [
        {"hidden_states": H, "semantic_id": None, "group_id": "g1"},
        "   ",
        {"hidden_states": H, "group_id": "g1", "id": 5, "prompt_id": 7, "style": True},
        {"hidden_states": H, "query_id": None, "id": None},
        {"hidden_states": H, "query_id": "7", "semantic_id": 7},
        {"hidden_states": H, "semantic_id": "7", "domain_id": 1.0, "style": "late"},
    ]
    rows = read(spark, tmp_path, lines)
    assert [r.row_index for r in rows] == [0, 1, 2, 3, 4]
    assert [r.id for r in rows] == ["0", "5", "None", "3", "4"]
    assert [r.query_id for r in rows] == ["0", "7", "None", "7", "4"]
    assert [r.semantic_key for r in rows] == [None, "'g1'", None, "7", "'7'"]
    assert [r.style_key for r in rows] == [None, "True", None, None, "1.0"]


def test_labels_are_fitted(spark, tmp_path):
    row = {"hidden_states": H, "correctness": True, "hallucinated": False, "onset": "3", "advantages": [1], "progress": [1, 2, 3, 4, 5], "key_prior": [], "unknown": "é"}
    r = read(spark, tmp_path, [row])[0]
    assert (r.correctness, r.path_hallucinated, r.hallucination_onset) == (1.0, 0.0, 3)
    assert (r.token_advantage, r.progress_targets, r.key_prior_target, r.complete_prior_target) == ([1, 0, 0, 0], [1, 2, 3, 4], [0, 0, 0, 0], None)
    assert json.loads(r.raw) == row


def test_nan_is_read(spark, tmp_path):
    r = read(spark, tmp_path, ['{"hidden_states": [[NaN, 2]], "id": "n"}'])[0]
    assert math.isnan(r.hidden_states[0][0]) and r.hidden_states[0][1] == 2 and r.id == "n"


@pytest.mark.parametrize(
    "line, said",
    [
        ("{bad", "line 2"),
        ("[1]", "line 2"),
        ({"id": 1}, "hidden_states"),
        ({"hidden_states": []}, "rank"),
        ({"hidden_states": [1, 2]}, "rank 2"),
        ({"hidden_states": H, "condition_embedding": H}, "rank 1"),
        ({"hidden_states": H, "csr_target": [1]}, "2 values"),
        ({"hidden_states_path": "x.bin"}, "unknown tensor file"),
    ],
)
def test_bad_lines(spark, tmp_path, line, said):
    with pytest.raises(Exception, match=said):
        read(spark, tmp_path, [{"hidden_states": H}, line])


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="no trajectories"):
        read(spark, tmp_path, ["", " "])


def test_tensor_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    np.save(tmp_path / "f" / "a.npy", np.arange(6.0).reshape(3, 2))
    (tmp_path / "f" / "b.json").write_text(json.dumps(H))
    rows = read(spark, tmp_path, [{"hidden_states_path": "f/a.npy", "condition_embedding": [1, 2]}, {"hidden_states_path": str(tmp_path / "f" / "b.json"), "hidden_states": None}])
    assert rows[0].hidden_states == [[0, 1], [2, 3], [4, 5]] and rows[1].hidden_states == H
    other = read(spark, tmp_path, [{"hidden_states_path": "a.npy"}], feature_root=str(tmp_path / "f"))
    assert len(other[0].hidden_states) == 3
    with pytest.raises(Exception, match="no tensor file"):
        read(spark, tmp_path, [{"hidden_states_path": "f/none.npy"}])


def test_many_splits_keep_line_order(spark, tmp_path):
    path = write(tmp_path / "rows.jsonl", ["" if i % 5 == 0 else json.dumps({"hidden_states": [[float(i)]], "id": i}) for i in range(300)])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sorted(trajectories.read_lines(spark, path).collect(), key=lambda r: r.row_index)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.row_index for r in rows] == list(range(240))
    assert [json.loads(r.value)["id"] for r in rows] == [r.line_no - 1 for r in rows] == [i for i in range(300) if i % 5]


def test_alias_expression(spark):
    df = spark.createDataFrame([('{"semantic_id":null,"group_id":"g"}',), ('{"group_id":"g"}',), ("{}",)], "raw string")
    assert [r[0] for r in df.select(labels.first_present(F.col("raw"), "semantic_id")).collect()] == [None, "g", None]


def test_toy(spark):
    rows = sorted(trajectories.toy_trajectories(spark).collect(), key=lambda r: r.row_index)
    assert [len(r.hidden_states) for r in rows] == [5, 6] * 3 and all(len(h) == 8 for r in rows for h in r.hidden_states)
    assert rows[1].token_advantage == pytest.approx([0.2, 0.4, 0.6, -0.5, -0.5, -0.5]) and rows[0].key_prior_target == [0, 1, 0, 0, 0]


# Batch plans


def plan(spark, keys, size, **options):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row_index long, semantic_key string")
    out = {}
    for r in sorted(batching.plan_batches(df, size, **options).collect()):
        out.setdefault(r.batch_id, []).append(r.row_index)
    return list(out.values())


def test_golden_plans(spark):
    assert plan(spark, "aabb", 2) == [[0, 1], [2, 3]]
    assert plan(spark, "aabb", 4) == [[0, 1, 2, 3]]
    assert plan(spark, "aaabb", 4) == [[0, 1, 3, 4], [2]]
    assert plan(spark, "aabbccddee", 5) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert batching.plan_length(spark.createDataFrame([(i, k) for i, k in enumerate("aabbccddee")], "row_index long, semantic_key string"), 5) == 3
    with pytest.raises(ValueError):
        plan(spark, "ab", 1)


def test_plan_invariants(spark):
    r = random.Random(5)
    for size in (2, 5, 7):
        keys = [r.choice("abcdefg") if r.random() < 0.8 else None for _ in range(60)]
        still = plan(spark, keys, size)
        mixed = plan(spark, keys, size, shuffle=True, seed=4, epoch=2)
        for batches in (still, mixed):
            assert sorted(x for b in batches for x in b) == list(range(60)) and max(map(len, batches)) <= size
        assert len(still) == len(mixed) and mixed == plan(spark, keys, size, shuffle=True, seed=4, epoch=2) != plan(spark, keys, size, shuffle=True, seed=4, epoch=3)
        assert all(len(b) == size for b in plan(spark, keys, size, drop_last=True))


def slow_plan(groups, size, drop_last):
    """The greedy plan, one chunk at a time."""
    chunks, spare = [], []
    for g in groups:
        for at in range(0, len(g), max(2, size // 2)):
            part = g[at : at + max(2, size // 2)]
            (chunks if len(part) > 1 else spare).append(part if len(part) > 1 else part[0])
    out, now = [], []

    def close():
        while len(now) < size and spare:
            now.append(spare.pop())
        if len(now) == size or now and not drop_last:
            out.append(list(now))
        now.clear()

    for c in sorted(chunks, key=len, reverse=True):
        if len(now) + len(c) > size:
            close()
        if len(c) == size:
            out.append(c)
        else:
            now.extend(c)
    close()
    while spare:
        part, spare = spare[:size], spare[size:]
        if len(part) == size or not drop_last:
            out.append(part)
    return out


def expand(groups, size, drop_last):
    """next_fit's runs written out."""
    m = max(2, size // 2)
    chunks, spare = [], []
    for g in groups:
        for at in range(0, len(g), m):
            part = g[at : at + m]
            (chunks if len(part) > 1 else spare).append(part)
    chunks.sort(key=len, reverse=True)
    sizes = {}
    for c in chunks:
        sizes[len(c)] = sizes.get(len(c), 0) + 1
    runs, tops, n = batching.next_fit(sizes, len(spare), size, drop_last)
    out = [{} for _ in range(n)]

    def put(r, item, i):
        for k, x in enumerate(item):
            slot = r.slot + i % r.per * r.width + k
            assert slot not in out[r.batch + i // r.per]
            out[r.batch + i // r.per][slot] = x

    for r in runs:
        for i in range(r.n):
            put(r, chunks[r.start + i], i)
    for r in tops:
        for i in range(abs(r.n)):
            put(r, spare[i] if r.n < 0 else spare[len(spare) - 1 - r.start - i], i)
    return [[b[k] for k in sorted(b)] for b in out]


def test_next_fit_by_counts():
    """Packing by counts of sizes is packing chunk by chunk, mid-plan drops included."""
    r = random.Random(11)
    for _ in range(3000):
        size, left = r.randint(2, 12), iter(range(10_000))
        groups = [[next(left) for _ in range(r.choice([1, 1, 2, 3, r.randint(1, 30)]))] for _ in range(r.randint(0, 25))]
        drop = r.random() < 0.5
        assert expand(groups, size, drop) == slow_plan(groups, size, drop), (groups, size, drop)


def test_split(spark):
    df = spark.range(50).withColumnRenamed("id", "row_index")
    a, b = batching.split(df, 0.25, 3)
    assert (a.count(), b.count()) == (38, 12) and not a.join(b, "row_index").count()
    assert batching.split(df, 0.0)[1] is None and batching.split(df, 0.001)[1].count() == 1
    with pytest.raises(ValueError):
        batching.split(df, 1.0)


# Selection


def test_best_of_n(spark):
    nan = float("nan")
    rows = [("q", 0, 1.0), ("q", 1, 2.0), ("q", 2, 2.0), ("n", 3, nan), ("n", 4, 9.0), ("m", 5, 1.0), ("m", 6, nan), ("z", 7, float("-inf"))]
    df = spark.createDataFrame(rows, "query_id string, row_index long, score double")
    assert {r.query_id: r.row_index for r in selection.best_of_n(df).where("selected").collect()} == {"q": 1, "n": 3, "m": 5, "z": 7}


def test_streaming(spark, tmp_path):
    rows = [("a", 0, 1.0, "2024-01-01 00:00:00"), ("a", 1, 3.0, "2024-01-01 00:01:00"), ("b", 2, 2.0, "2024-01-01 00:02:00"), ("c", 3, 0.0, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "query_id string, row_index long, score double, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    running = streaming_best_of_n(stream, "t").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    running.awaitTermination(120)
    assert {(r.query_id, r.row_index, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 1, 3.0), ("b", 2, 2.0)}


# Sequences


def test_sequence_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [False, True, True])], "a array<double>, z array<double>, f array<boolean>")
    r = df.select(q.l2_normalize("a"), q.l2_normalize("z"), q.layer_norm("a"), q.pad_or_trim("a", 3), q.pad_or_trim("a", 1), q.first_true("f"), q.dot("a", "a"), q.bce(F.lit(1.0), F.lit(0.0)), q.relu(F.lit(-1))).first()
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0, 0] and r[2] == pytest.approx([-1, 1], abs=1e-4)
    assert (r[3], r[4], r[5], r[6], r[7], r[8]) == ([3, 4, 0], [3], 1, 25, 100, 0)


# The model

CONFIG = RewardConfig(hidden_dim=8, projection_dim=4, condition_attention_dim=5)


def slow_forward(p, c, h, cond):
    """The model's formulas, written out over scalars."""
    lin = lambda n, x: [sum(w * v for w, v in zip(row, x, strict=True)) + b for row, b in zip(p[f"{n}.weight"], p.get(f"{n}.bias", np.zeros(len(p[f"{n}.weight"]))), strict=True)]
    unit = lambda x: [v / max(math.sqrt(sum(t * t for t in x)), 1e-12) for v in x]

    def norm(n, x):
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return [(v - mean) / math.sqrt(var + 1e-5) * w + b for v, w, b in zip(x, p[f"{n}.weight"], p[f"{n}.bias"], strict=True)]

    gelu = lambda x: [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]
    soft = lambda x: [math.exp(v) / sum(math.exp(t) for t in x) for v in x]
    feats, relevance = [], []
    for t in h:
        if not len(cond):
            feats.append(list(t))
            relevance.append(0.0)
            continue
        qv = unit(lin("condition_query", t))
        ks, vs = [unit(lin("condition_key", x)) for x in cond], [lin("condition_value", x) for x in cond]
        att = soft([sum(a * b for a, b in zip(qv, k, strict=True)) / c.condition_attention_temperature for k in ks])
        ctx = [sum(a * v[i] for a, v in zip(att, vs, strict=True)) for i in range(len(vs[0]))]
        matched = [sum(a * k[i] for a, k in zip(att, ks, strict=True)) for i in range(len(qv))]
        rel = sum(a * b for a, b in zip(qv, matched, strict=True))
        proj = lin("condition_hidden_proj", t)
        fused = norm("fusion_norm", [*proj, *ctx, *(a * b for a, b in zip(proj, ctx, strict=True)), *(a - b for a, b in zip(proj, ctx, strict=True)), rel])
        delta = lin("delta", lin("fusion_2", gelu(lin("fusion_1", fused))))
        feats.append(norm("feature_norm", [a + b for a, b in zip(t, delta, strict=True)]))
        relevance.append(rel)
    gates = [1 / (1 + math.exp(-lin("token_reward", x)[0])) for x in feats]
    values = [lin("token_reward", x)[1] + c.progress_score_weight * lin("progress", x)[0] for x in feats]
    pooled = [sum(x[i] for x in feats) / len(feats) for i in range(c.hidden_dim)]
    key, comp = soft([lin("key_prior", x)[0] for x in feats]), soft([lin("complete_prior", x)[0] for x in feats])
    ctx = [sum(a * x[i] for a, x in zip(comp, feats, strict=True)) for i in range(c.hidden_dim)]
    return {
        "score": sum(g * v for g, v in zip(gates, values, strict=True)) / sum(gates) + lin("final_score", pooled)[0],
        "representation": unit(lin("project", norm("project_norm", pooled))),
        "fused_prior": [c.prior_fusion_alpha * a + (1 - c.prior_fusion_alpha) * b for a, b in zip(key, comp, strict=True)],
        "condition_relevance": relevance,
        "reconstruction": lin("reconstruct_2", gelu(lin("reconstruct_1", ctx))),
        "hallucination_logits": [lin("hallucination", x)[0] for x in feats],
    }


def test_forward(spark):
    p = forward.initial(CONFIG, 3)
    p = {k: v + 0.1 * np.random.default_rng(1).normal(size=v.shape) for k, v in p.items()}
    rows = trajectories.toy_trajectories(spark).withColumn("condition_states", F.when(F.col("row_index") != 2, F.col("condition_states"))).withColumn("condition_embedding", F.when(F.col("row_index") == 3, F.get("hidden_states", F.lit(0))))
    got = {r.row_index: r for r in forward.forward(rows, p, CONFIG).collect()}
    for r in rows.collect():
        cond = [*(r.condition_states or []), *([r.condition_embedding] if r.condition_embedding else [])]
        for k, v in slow_forward(p, CONFIG, r.hidden_states, cond).items():
            assert got[r.row_index][k] == pytest.approx(v, abs=1e-9), k
    changed = rows.withColumn("condition_states", F.transform("condition_states", lambda c, i: F.transform(c, lambda x: F.when(i == 0, x + 5).otherwise(x).cast("float"))))
    again = {r.row_index: r for r in forward.forward(changed, p, CONFIG).collect()}
    assert again[0].key_prior != got[0].key_prior and again[2].key_prior == got[2].key_prior
    with pytest.raises(Exception, match="hidden_states must be"):
        forward.forward(rows, p, replace(CONFIG, hidden_dim=9)).collect()


def test_parameters():
    count = lambda d: forward.n_parameters(RewardConfig(hidden_dim=d, projection_dim=64, condition_attention_dim=64))
    assert (count(512), count(4096)) == (290_121, 2_171_721)
    assert round(forward.n_parameters(RewardConfig(hidden_dim=135_168)) / 1e6, 1) == 278.9


# Losses


def test_partial_prior_mask(spark):
    key, comp, gate = [0.7, 0.1, 0.1, 0.1], [0.2, 0.2, 0.3, 0.3], [0.7, 0.1, 0.1, 0.1]
    tokens = spark.createDataFrame([(0, 0, i, key[i], comp[i], gate[i], comp[i], 0.0, 0.0, *((1.0, 1.0) if i < 2 else (None, None))) for i in range(4)], "batch_id long, row_index long, pos int, key_prior double, complete_prior double, gates double, fused_prior double, key_prior_logits double, complete_prior_logits double, key_t double, comp_t double")
    rows = spark.createDataFrame([(0, None, None)], "batch_id long, reconstruction array<double>, complete_reconstruction_target array<double>")
    r = losses.prior_losses(rows, tokens, replace(CONFIG, key_prior_weight=0.0, complete_prior_weight=0.0, prior_distill_weight=1.0, gate_prior_weight=1.0, reconstruction_weight=0.0), "key").first()
    assert r.prior_distill == pytest.approx(0.13, abs=1e-9) and r.prior_gate == pytest.approx(0.13, abs=1e-9) and r.prior_complete == 0
    none = losses.prior_losses(rows, tokens.withColumn("key_t", F.lit(None).cast("double")).withColumn("comp_t", F.lit(None).cast("double")), CONFIG).first()
    assert none.prior_total == 0.0
    with pytest.raises(ValueError):
        Phase("other")


def toy_tables(spark):
    rows = trajectories.toy_trajectories(spark)
    plan = batching.plan_loader(rows.select("row_index", "semantic_key"), 4, True, True, 1)
    return rows, plan


def test_losses_and_phases(spark):
    rows, plan = toy_tables(spark)
    p = forward.initial(CONFIG)
    by = {ph: train_plan.evaluate(rows, plan, p, CONFIG, ph).collect() for ph in ("joint", "key", "complete")}
    for j, k, c in zip(*by.values(), strict=True):
        assert k.prior_complete == 0 == c.prior_key and j.prior_distill == pytest.approx(2 * k.prior_distill) and j.prior_gate == pytest.approx(k.prior_gate) and k.prior_gate > 0
        assert j.consistency_positive > 0 and all(math.isfinite(j[m]) for m in METRICS)
        assert j.total == pytest.approx(j.final + j.consistency_total + j.localization_token_bce + 0.5 * j.localization_token_reward + 0.5 * j.localization_tail_margin + 0.25 * j.hallucination_mil + 0.1 * j.pseudo_tail + 0.25 * j.progress + 0.25 * j.prior_total)
    sizes = [r.batch_size for r in by["joint"]]
    mean = losses.epoch_means(train_plan.evaluate(rows, plan, p, CONFIG)).first()
    assert mean.total == pytest.approx(sum(r.total * n for r, n in zip(by["joint"], sizes, strict=True)) / sum(sizes))
    assert [train_plan.phase_of("alternate", e) for e in (1, 2, 3)] == ["key", "complete", "key"] and train_plan.phase_of("joint", 2) == "joint"


@pytest.mark.parametrize("onset, known, fine", [(2, True, False), (1, True, True), (-5, True, True), (9, False, True)])
def test_onset_range(spark, onset, known, fine):
    df = spark.createDataFrame([(0, 2, onset if known else None)], "row_index long, n_tokens int, hallucination_onset int")
    if fine:
        losses.check_onsets(df).collect()
    else:
        with pytest.raises(Exception, match="hallucination_onset"):
            losses.check_onsets(df).collect()


def test_gaps_in_labels(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, None, 3.0), (1, 2, None, 1.0)], "batch_id long, row_index long, correctness double, score double")
    got = {r.batch_id: r.final for r in rows.groupBy("batch_id").agg(losses.final_term()).collect()}
    bce = lambda x, t: max(x, 0) - x * t + math.log1p(math.exp(-abs(x)))
    assert got[0] == pytest.approx((bce(2.0, 1) + bce(3.0, 0)) / 2) and got[1] == 0


# Training and scoring


def test_training_lowers_the_objective(spark):
    rows = trajectories.toy_trajectories(spark)
    seen = []
    train_plan.train(rows, CONFIG, epochs=6, rate=0.05, log=seen.append)
    assert seen[-1]["train"]["localization_token_bce"] < seen[0]["train"]["localization_token_bce"] and seen[-1]["train"]["progress"] < seen[0]["train"]["progress"]


def test_gradients(spark):
    """Against differences of the supervised token losses over all tokens."""
    rows = trajectories.toy_trajectories(spark)
    p = forward.initial(CONFIG, 2)
    grads = train_plan.gradients(rows, p, CONFIG)
    data = [r.asDict() for r in rows.collect()]

    def value(p):
        total = n = 0
        for r in data:
            x, _, _ = forward.condition(p, CONFIG, np.array(r["hidden_states"], float), np.array(r["condition_states"], float))
            head = lambda k, i=0: x @ p[f"{k}.weight"][i] + p[f"{k}.bias"][i]  # noqa: E731, B023
            bce = lambda z, t: np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z)))
            tail = np.arange(len(x)) >= r["hallucination_onset"] if r["hallucination_onset"] >= 0 else np.zeros(len(x), bool)
            v = head("token_reward", 1) + 0.5 * head("progress")
            target = np.where(tail, -0.5, r["token_advantage"])
            total += bce(head("hallucination"), tail).sum() + 0.5 * ((v - target) ** 2).sum() + 0.5 * (np.maximum(v + 0.5, 0)[tail] ** 2).sum() + 0.25 * ((head("progress") - r["progress_targets"]) ** 2).sum()
            total += 0.25 * (bce(head("key_prior"), np.array(r["key_prior_target"])) + bce(head("complete_prior"), np.array(r["complete_prior_target"]))).sum()
            n += len(x)
        return total / n

    for name, at in (("token_reward.weight", (1, 3)), ("progress.bias", (0,)), ("hallucination.weight", (0, 2)), ("key_prior.weight", (0, 0)), ("complete_prior.bias", (0,))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert grads[name][at] == pytest.approx((value(up) - value(down)) / 2e-5, abs=1e-6)


def test_score_plan(spark, tmp_path):
    lines = [{"id": k, "query_id": "q", "hidden_states": np.random.default_rng(k).normal(size=(3 + k, 8)).tolist(), "note": "ü"} for k in range(3)]
    data = write(tmp_path / "rows.jsonl", lines)
    forward.save(spark, forward.initial(CONFIG), CONFIG, str(tmp_path / "model"))
    score_plan.run(spark, data, str(tmp_path / "model"), str(tmp_path / "out"))
    out = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert [r["id"] for r in out] == [0, 1, 2] and sum(r["clir_selected_best_of_n"] for r in out) == 1
    best = max(out, key=lambda r: r["clir_score"])
    assert best["clir_selected_best_of_n"] and best["note"] == "ü" and all(len(r["clir_gate_attention"]) == len(r["hidden_states"]) for r in out)
    assert sum(out[0]["clir_gate_attention"]) == pytest.approx(1) and {f for f in out[0] if f.startswith("clir_")} == {"clir_score", "clir_path_hallucination_prob", "clir_pseudo_onset", "clir_mean_gate", "clir_prior_gate_alignment", "clir_condition_relevance", "clir_gate_attention", "clir_key_prior", "clir_complete_prior", "clir_selected_best_of_n"}
    sinks.write_table(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "t"))
    assert [x for f in (tmp_path / "t").glob("part-*") for x in f.read_text().splitlines()] == ['{"a":1,"b":null}']
