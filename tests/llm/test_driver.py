"""What steps leave on disk and ask of the driver."""

import gc
import os
import random
import time
import tracemalloc

import corpus_pipeline
import pytest
from conftest_llm import SF, components
from pyspark.sql import functions as F

from strandline import scratch
from strandline.llm import common, copies, quality, secrets


def path(table):
    return table._strandline_path.removeprefix("file:")


def collected(spark, gone):
    """Whether cut() deletes the table once the JVM has collected its plans."""
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        scratch.cut(spark.range(1), "other")
        if not os.path.exists(gone):
            return True
        time.sleep(0.2)
    return False


def test_tables_go_with_their_last_plan(spark):
    t = scratch.cut(spark.range(100), "kept")
    where, kept = path(t), t.where("id % 2 = 1").join(t.withColumnRenamed("id", "x"), F.col("id") == F.col("x"))
    del t
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    scratch.cut(spark.range(1), "other")
    assert kept.count() == 50 and os.path.exists(where)
    kept = kept.cache()
    assert kept.count() == 50
    kept.unpersist()
    del kept
    assert collected(spark, where)


def test_stages_leave_no_texts(spark, monkeypatch):
    """Copies of all texts that near-dedup and the scans make go once their results are written."""
    made = {}

    def seen(df, name):
        out = common.cut(df, name)
        made[name] = path(out)
        return out

    monkeypatch.setattr(copies, "cut", seen)
    monkeypatch.setattr(secrets, "cut", seen)
    docs = scratch.cut(spark.read.parquet(f"{SF}/documents.parquet"), "docs")
    for stage in (corpus_pipeline.keep_one_of_each, corpus_pipeline.redact_secrets):
        docs = common.cut(stage(spark, docs, SF), "stage")
    assert {"shingled", "tokens"} <= set(made)
    assert all(collected(spark, made[k]) for k in ("shingled", "tokens"))
    assert docs.count() > 0


@pytest.mark.parametrize("held", [1 << 19, 4])
def test_components_with_and_without_rounds(spark, monkeypatch, held):
    """A task settles what it can hold, in two tables; more takes rounds. Both as by brute force."""
    r = random.Random(5)
    edges = [(r.randrange(300) - 150, r.randrange(300) - 150) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(7000, k) for k in range(7001, 7030)] + [(9000, 9000)]
    links = set(edges) | {(b, a) for a, b in edges}
    want = components({x for e in edges for x in e if e[0] != e[1]}, lambda a, b: (a, b) in links)
    tables = []

    def seen(df, name):
        tables.append(name)
        return scratch.cut(df, name)

    monkeypatch.setattr(common, "cut", seen)
    monkeypatch.setattr(common, "HELD", held)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()
    assert sorted(tuple(x) for x in got) == sorted(want.items())
    assert len(tables) == 2 if held > 4 else len(tables) > 4
    none = common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b")
    assert none.columns == ["node", "component"] and none.count() == 0


def test_near_dedup_makes_few_tables(spark, monkeypatch):
    """Every table is a plan of the driver's: no rounds where a task can hold the links."""
    tables = []

    def seen(df, name):
        tables.append(name)
        return scratch.cut(df, name)

    for module in (common, copies):
        monkeypatch.setattr(module, "cut", seen)
    texts = [" ".join(f"w{k}-{i}" for i in range(50)) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts + texts[:5])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == list(range(30))
    assert len(tables) <= 25, tables


def test_training_rows_stay_in_arrow(spark, monkeypatch):
    """The driver holds no Python object for each number that it learns from, and learns from the same ones."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, first, y: seen.update(x=x, first=first, y=y))
    quality.train(docs, labels)
    tracemalloc.start()
    quality.train(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    known = {r.doc_id: r.quality for r in labels.where(F.col("quality").isNotNull() & ~quality.held_out(F.col("doc_id"))).collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in known), key=lambda r: r.doc_id)
    x, first = quality.features([r.text.encode() for r in rows])
    assert (seen["x"] == x).all() and (seen["first"] == first).all() and seen["y"].tolist() == [known[r.doc_id] > 0 for r in rows]
    assert most < 3 * x.nbytes, (most, x.nbytes)
