"""The quality classifier: gradients, held-out accuracy, odd inputs, and the pipeline."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import SF, components
from pyspark.sql import functions as F
from test_pairs import slow_fingerprint
from test_words import check_packing, slow_targets

from strandline.llm import mixing, quality, queries, secrets
from strandline.llm.common import cut


def test_attention_sums_to_one_and_pools():
    r = np.random.default_rng(0)
    x, first = r.normal(size=(12, quality.N_FEATURES)), np.array([0, 3, 4, 12])
    p = quality.fit(x, first, np.array([0, 1, 1]), epochs=2)
    o = quality.forward(p, x, first)
    assert np.add.reduceat(o["a"], first[:-1]) == pytest.approx(np.ones(3))
    for k in range(3):
        one = quality.forward(p, x[first[k] : first[k + 1]], np.array([0, first[k + 1] - first[k]]))
        assert one["score"] == pytest.approx(o["score"][k : k + 1])


def test_learns_from_one_telling_passage():
    """A bag is bad if any of its passages is; labels say nothing about passages."""
    r = np.random.default_rng(1)
    sizes = r.integers(1, 9, 600)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = r.normal(size=(first[-1], quality.N_FEATURES))
    y = np.ones(600)
    for k in range(600):
        if r.random() < 0.4:
            y[k] = 0
            x[r.integers(first[k], first[k + 1]), :4] += 3
    cut_at = 400
    p = quality.fit(x[: first[cut_at]], first[: cut_at + 1], y[:cut_at])
    said = quality.forward(p, x[first[cut_at] :], first[cut_at:] - first[cut_at])["score"] > 0.5
    assert (said == y[cut_at:]).mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(6, 1), (8, 0), (9, None), (None, 1), (11, 1), (12, 0), (12, 1), (999, 1)], "doc_id long, quality int")
    params = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs.withColumn("score", F.lit("x")), params).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip(" \t\n")}) == 1
    none = quality.train(no_docs, labels.limit(0))
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in quality.score(odd_docs, none).collect())
    assert quality.score(no_docs, none).count() == 0


def test_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark):
    """Each stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = cut(stage(spark, docs, SF), f"test{k}")
        kept[name] = after = docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if k == 0:
            junk = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
            assert len(after) > 0.7 * len(before) and {r.doc_id for r in after} <= {r.doc_id for r in before}
            assert len(junk & {r.doc_id for r in after}) <= 1
        elif k == 1:
            fp = {r.doc_id: slow_fingerprint(r.text) for r in before}
            comp = components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
            assert {r.doc_id for r in after} == {d for d, c in comp.items() if d == c}
        elif k == 2:
            text = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            for r in after:
                assert r.n_chars == len(r.text) and not re.search(secrets.PATTERNS["hex"].replace("}+", "}"), r.text) and (r.text == text[r.doc_id]) == ("[secret]" not in r.text)
        elif k == 3:
            size = Counter()
            for r in before:
                size[r.source] += len(r.text.split())
            want, taken = slow_targets(size), Counter()
            for r in after:
                taken[r.source] += len(r.text.split())
            longest = max(len(r.text.split()) for r in before)
            assert max(Counter(r.doc_id for r in after).values()) <= 2 and all(abs(taken[s] - want[s]) <= longest for s in size)
        else:
            check_packing(spark.createDataFrame(before), [(r.doc_id, r.text) for r in before], 4096)
            assert len(after) >= len(before)
    assert corpus_pipeline.run(spark, SF).count() == len(kept["best-fit packing"])


def test_pipeline_keeps_repeated_rows_once(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()
    assert max(Counter(r.doc_id for r in kept).values()) == 1 and not any(r.doc_id == 7 for r in kept)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixing.emit is not None
