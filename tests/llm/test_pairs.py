"""SimHash and embedding near-duplicates against all pairs."""

import math
import random

import numpy as np
import pytest
import xxhash
from conftest_llm import SF, components
from pyspark.sql import functions as F

from strandline.llm import simhash, vectors


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, odd_docs):
    docs = [odd_docs, spark.read.parquet(f"{SF}/documents.parquet")]
    for df in docs:
        rows = df.select("doc_id", "text").collect()
        want = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
        comp = components({f for _, f in want}, lambda a, b: (a ^ b).bit_count() <= 4)
        first = {}
        for d, f in want:
            if d is not None:
                first[comp[f]] = min(first.get(comp[f], d), d)
        got = simhash.near_duplicates(df).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(((d, f, first.get(comp[f])) for d, f in want), key=key)


@pytest.mark.parametrize("crowd", [1024, 32, 3])
def test_links_of_clusters(spark, monkeypatch, crowd):
    """Clusters larger than the crowd limit go through full balls; no link is lost."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = r.getrandbits(64)
        bits = r.sample(range(64), 10)
        fps |= {centre ^ sum(1 << b for b in r.sample(bits, r.randint(0, 5))) for _ in range(80)}
        fps |= {centre ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32)) ^ (1 << (32 + r.randrange(32))) ^ (1 << (32 + r.randrange(32))) for _ in range(40)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.connected_components(simhash.links(df), "a", "b").collect()
    want = components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    assert {r.node: r.component for r in got} == {n: c for n, c in want.items() if list(want.values()).count(c) > 1}


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def check_vectors(df, rows, threshold=0.93):
    got = {}
    for r in vectors.near_duplicates(df, threshold).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    good = lambda v, lab: lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    linked = lambda a, b: good(a[1], a[2]) and good(b[1], b[2]) and a[2] == b[2] and len(a[1]) == len(b[1]) and vectors.cosine(np.array(a[1], float), np.array(b[1], float)) >= threshold
    comp = components([i for i, _, _ in rows], lambda x, y: linked(by[x], by[y])) if (by := {r[0]: r for r in rows}) else {}
    for r in rows:
        n = sum(linked(r, s) for s in rows if s[0] != r[0])
        assert got[r[0]] == [(n, comp[r[0]])], r[0]


def test_vectors_odd(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=8)
    rows = [(0, None, 1), (1, [0.0] * 8, 1), (2, [float("nan")] * 8, 1), (3, [None] * 8, 1), (4, centre.tolist(), None), (5, [1.0, 2.0], 1), (6, [2.0, 4.0], 1), (7, [], 1), (8, [math.inf] * 8, 1)]
    for k in range(10, 150):
        v = centre + r.normal(size=8) * r.choice([0.0, 0.3, 1.0])
        rows.append((k, (v * r.choice([1.0, 3.0])).tolist(), int(k % 2)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(3)).repartition(3)
    check_vectors(df, rows)


def test_vectors_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 16)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_vectors(df, [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    assert vectors.near_duplicates(df.limit(0)).count() == 0
