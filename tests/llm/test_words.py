"""Packing, repeats, mixing, licenses against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SF
from pyspark.sql import functions as F

from strandline.llm import licenses, mixing, packing, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_cover():
    d = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert d == set(range(repeats.PERIOD))


@pytest.mark.parametrize("window, period, cover", [(35, 21, repeats.COVER), (4, 3, (0, 1))])
def test_repeats(spark, odd_docs, window, period, cover):
    docs = odd_docs.union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "n_chars", F.lit("x"), F.lit(2))) if window == 35 else odd_docs
    rows = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    seen = Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    want = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [tuple(r) for r in repeats.remove_repeats(docs, window=window, period=period, cover=cover).collect()]
    key = lambda r: (r[0] is None, r)[0:1] + (str(r),)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 1000


def test_repeats_of_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one hash under any polynomial modulo 2**64."""
    tm = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    rest = [f"w{k}" for k in range(34)]
    docs = spark.createDataFrame([(1, " ".join([tm, *rest])), (2, " ".join([tm.translate({97: "b", 98: "a"}), *rest]))], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(docs).collect()] == [0, 0]
    # The same at the level of words: 32 words in either order of two.
    one = [("x", "y")[k.bit_count() % 2] for k in range(32)]
    two = [("y", "x")[k.bit_count() % 2] for k in range(32)]
    docs = spark.createDataFrame([(1, " ".join([*one, "q", "r", "s"])), (2, " ".join([*two, "q", "r", "s"]))], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(docs).collect()] == [0, 0]


def test_repeats_empty(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0


def check_packing(docs, rows, size):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.default_tokenizer())
    full.encode_special_tokens = True
    want = Counter()
    total = 0
    for d, t in rows:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), size):
            part = np.array(ids[k : k + size], "<u4")
            want[d, k // size, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack(docs, max_tokens=size).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= 1.05 * total / size + 2


def test_packing(spark, odd_docs):
    check_packing(odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()], 4096)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(docs, [(r.doc_id, r.text) for r in docs.collect()], 512)


def test_packing_sequences(spark, odd_docs, no_docs):
    for r in packing.sequences(odd_docs).collect():
        assert len(r.input_ids) <= 4096 and r.input_ids[-1] == 1 or len(r.input_ids) == 4096
    assert packing.pack(no_docs).count() == 0


def test_packing_plan():
    r = np.random.default_rng(0)
    for hist in (np.bincount(r.integers(1, 101, 5000), minlength=101), np.bincount(r.geometric(0.05, 30000).clip(1, 100), minlength=101), np.zeros(101, int)):
        p = packing.plan(hist, 100)
        fill = Counter()
        for length in range(1, 101):
            runs = [k for k in range(len(p["length"])) if p["length"][k] == length]
            assert [p["first"][k] for k in runs] == sorted(p["first"][k] for k in runs)
            ends = [*(int(p["first"][k]) for k in runs[1:]), int(hist[length])][: len(runs)]
            assert runs or not hist[length]
            for k, end in zip(runs, ends, strict=True):
                for i in range(end - int(p["first"][k])):
                    fill[int(p["seq"][k]) + i // int(p["per"][k])] += length
        assert max(fill.values(), default=0) <= 100
        assert sum(fill.values()) == (hist * np.arange(101)).sum()
        assert len(fill) == p["sequences"][0] <= 1.01 * (hist * np.arange(101)).sum() / 100 + 1


def slow_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t | {s: 2 * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark, odd_docs):
    docs = odd_docs.union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "n_chars", F.lit("x"), F.lit(2)))
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    got = mixing.mix(sized).collect()
    assert len(got) == sized.count() and set(got[0].asDict()) == {*sized.columns, "source_size", "target", "copies"}
    per, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 2
        per[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    want = slow_targets(per)
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(want[r.source])
    for s in per:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(sized.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in got) == Counter((r.doc_id, r.size, r.copies) for r in again)
    assert mixing.emit(mixing.mix(sized)).count() == sum(r.copies for r in got)


def test_mixing_cells(spark, no_docs):
    """Cells of one size that are split, and nothing at all."""
    df = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "10L as size")
    got = {r.source: r for r in mixing.mix(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()}
    for r in got.values():
        assert abs(r.taken - r.target) <= 10 and r.most <= 2
    assert mixing.mix(no_docs.withColumn("size", F.lit(1).cast("long"))).count() == 0


def test_licenses(spark, odd_docs, no_docs):
    extra = [(100, "x CC BY 4.0, cc-by. Cc\n\tBy"), (101, "GNU General Public License, all rights reserved"), (102, "general public. licence public license general public license"), (103, "Permission is hereby freely granted, free of charge, to any person obtaining a copy of this software and its associated documentation files"), (104, "all éall rights reserved cc")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    docs = docs.union(docs.where("doc_id = 101"))
    docs.write.mode("overwrite").parquet(path := "/tmp/strandline-test-licenses/documents.parquet")
    want = []
    for r in docs.collect():
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        want.append((r.doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    got = licenses.op9_licenses(spark, path.rpartition("/")[0]).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    by = {r.doc_id: r for r in got}
    assert by[103].labels == "mit" and 0.75 <= by[103].score < 1
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(no_docs).count() == 0


def test_long_texts_differ_in_hash():
    a, b = repeats.Words([b"a b c d e"]), repeats.Words([b"a b c d f"])
    assert a.runs(np.array([0]), 4) == b.runs(np.array([0]), 4) and a.runs(np.array([1]), 4) != b.runs(np.array([1]), 4)


def test_added_tokens_in_texts():
    """A text that holds an added token gets the ids of the plain tokenizer."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = ["one <|endoftext|> two", "one<|startoftext|>two <|ENDOFTEXT|> é", "<|endoftext|>\u0338 x", "none of them, here."]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert encoder.by_chunk and got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and 49407 in got[0]
