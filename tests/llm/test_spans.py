"""Spans in long texts, the span classifier, and the battery under planted nulls."""

import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import pii, secrets
from strandline.llm import spans as S


def test_running_and_below(spark):
    """Prefixes over several blocks, and bisection, against Python."""
    r = random.Random(4)
    rows = [[r.randint(-9, 9) for _ in range(n)] for n in (1, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(x,) for x in rows], "x array<int>")
    got = df.select(S.running(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("sum"), S.running(F.col("x"), lambda a, b: F.greatest(a, b), F.lit(-99)).alias("max"), F.array_sort("x").alias("s"), S.below(F.array_sort("x"), F.lit(2)).alias("n")).collect()
    for x, y in zip(rows, got, strict=True):
        assert y["sum"] == np.cumsum(x).tolist() and y["max"] == np.maximum.accumulate(x).tolist() and y["n"] == sum(v < 2 for v in x)


def test_outside(spark):
    r = random.Random(5)
    span = lambda: (lambda a: {"kind": "k", "start": a, "end": a + r.randint(1, 9)})(r.randint(0, 400))
    rows = [([span() for _ in range(r.randint(0, 60))], [span() for _ in range(r.randint(0, 40))]) for _ in range(30)]
    kind = "array<struct<kind:string,start:int,end:int>>"
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}").select("a", "b", S.outside(F.col("a"), F.col("b")).alias("o")).collect()
    for x in got:
        assert x.o == [s for s in x.a if not any(s.start < t.end and t.start < s.end for t in x.b)]


def test_many_matches_in_one_text(spark):
    """100,000 matches take time in proportion."""
    text = " ".join(f"a{i}@b.co 1.2.3.{i % 250}" for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.candidates(F.col("text"))
    began = time.perf_counter()
    got = df.select(F.size(S.find(F.col("text"), r"[a-z0-9]+@[a-z.]+|[0-9.]{7,}", "k", F.lit(True), 24)).alias("n")).first()
    assert got.n == 100_000 and time.perf_counter() - began < 10
    assert {r.kind for r in pii._voted(df, "text").select(F.explode("_base").alias("s")).select("s.kind").distinct().collect()} == {"email", "ip"}


def slow_loose(text):
    """Loose spans that touch no strict one, by Python's own expressions."""
    import re

    from test_native import PII, expected

    _, said = expected(text, PII, True)
    taken = [tuple(map(int, s.split(":")[1:])) for s in said.split(",") if s]
    plain = {k: p.replace("++", "+") for k, p in pii.LOOSE.items()}
    spans = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text)]
    return sorted(s for s in spans if not any(s[1] < b and a < s[2] for a, b in taken))


def test_loose_spans(spark):
    """Every loose candidate outside strict spans, and its score from the votes and features."""
    from test_native import TRICKY

    texts = [*TRICKY[:-1], "ssn 123-45-6789, 900-12-3456; tel 555-123-4567 (555) 123 4567 bob (at) ex (dot) com GB82WEST12345698765432"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii._voted(docs, "text").collect()}
    for i, t in enumerate(texts):
        assert sorted((s.kind, s.start, s.end) for s in rows[i]._loose) == slow_loose(t)
    voted = pii._voted(docs, "text")
    odds, w = pii.learn(voted)
    for r in pii.scan(docs).collect():
        spans = [*rows[r.doc_id]._base, *rows[r.doc_id]._loose]
        said = {}
        if spans:
            kinds = np.array([pii.KINDS.index(s.kind) for s in spans])
            x = pii.design(kinds, np.array([s.features for s in spans]))
            total = x @ w[:-1] + w[-1] + pii.said(odds, kinds, np.array([s.votes for s in spans]))
            said = {(s.kind, s.start, s.end): p for s, p in zip(spans, 1 / (1 + np.exp(-total)), strict=True)}
        base = {(s.kind, s.start, s.end) for s in rows[r.doc_id]._base}
        assert {(s.kind, s.start, s.end) for s in r.spans} == base | {k for k, p in said.items() if p >= 0.5}
        assert all(s.score == pytest.approx(said[s.kind, s.start, s.end]) for s in r.spans)


def test_classifier_sees_more_than_votes():
    """Where labelers abstain on what a feature tells, the classifier follows the feature."""
    r = np.random.default_rng(0)
    n = 6000
    truth = r.random(n) < 0.5
    votes = np.stack([np.where(r.random(n) < 0.85, np.where(truth, 1, -1), np.where(truth, -1, 1)) for _ in range(3)] + [np.zeros(n, int)] * 2, 1)
    silent = r.random(n) < 0.3
    votes[silent] = 0
    marks = np.stack([truth * 2 + r.integers(0, 2, n), r.integers(0, 3, n), r.integers(0, 16, n)], 1)
    kinds = r.integers(0, 2, n)
    odds, w = pii.fit(kinds, votes, marks, np.ones(n))
    by_votes = pii.said(odds, kinds, votes)
    said = pii.design(kinds, marks) @ w[:-1] + w[-1] + by_votes > 0
    assert (said == truth)[silent].mean() > 0.95 > ((by_votes > 0) == truth)[silent].mean() + 0.2
    assert (said == truth)[~silent].mean() >= ((by_votes > 0) == truth)[~silent].mean()


def p_values(spark, tokens):
    df = spark.createDataFrame(list(enumerate(tokens)), "i long, t string").repartition(4)
    return [r.b[0].p_random for r in df.select("i", secrets.battery(F.col("t")).alias("b")).orderBy("i").collect()]


def test_battery_keeps_its_level(spark):
    """Under the null, small p-values are no more frequent than they say."""
    r = random.Random(11)
    for symbols in (string.ascii_letters + string.digits, "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789"):
        for n in (20, 40, 80):
            p = np.array(p_values(spark, ["".join(r.choice(symbols) for _ in range(n - 2)) + symbols[0] + symbols[-1] for _ in range(1500)]))
            assert (p <= 0.01).mean() < 0.025 and (p <= 0.1).mean() < 0.16


def test_false_discoveries_of_the_battery(spark):
    """Planted nulls (secrets) among ordinary tokens: few of the dismissed are secrets, nearly all secrets stay."""
    r = random.Random(12)
    b62 = string.ascii_letters + string.digits
    secret = ["".join(r.choice(b62) for _ in range(r.choice((36, 40, 48, 64)))) for _ in range(300)]
    syllables = "the an er on re at en es or ti is ing ne al".split()
    plain = ["".join(r.choice(syllables) for _ in range(r.randint(14, 24))) for _ in range(1500)]
    rows = [(i, f"x {t} y") for i, t in enumerate(secret + plain)]
    got = {x.doc_id: bool(x.spans) for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), text=1.0).collect()}
    dismissed = [i for i in got if not got[i]]
    assert sum(i < 300 for i in dismissed) <= 0.02 * len(dismissed) and sum(got[i] for i in range(300)) > 280
    told = {x.doc_id: bool(x.spans) for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(told[i] for i in range(300)) > 270 and sum(told[i] for i in range(300, 1800)) < 15


def test_mixed_alphabets_are_tested(spark):
    r = random.Random(13)
    token = "".join(r.choice(string.ascii_letters + string.digits + "+/-_") for _ in range(60)) + "+-"
    assert secrets.scan(spark.createDataFrame([(1, f"k {token} z")], "doc_id long, text string")).first().spans
