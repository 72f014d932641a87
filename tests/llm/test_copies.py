"""Near copies of the pipeline against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline
import pyarrow as pa
from conftest_llm import SF, components
from pyspark.sql import functions as F

from strandline.llm import common, copies


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def edited(r, n, changes):
    words = [f"w{r.randrange(10**6)}" for _ in range(n)]
    other = list(words)
    for at in r.sample(range(n), changes):
        other[at] = f"x{r.randrange(10**6)}"
    return " ".join(words), " ".join(other)


def check(spark, docs):
    rows, member = copies.near_copies(docs)
    got = [(r.text, r.component) for r in rows.join(member, "_node").select("text", "component").collect()]
    sets = {t: shingle_set(t) for t, _ in got}
    comp = components({t or "" for t in sets}, lambda a, b: similar(sets.get(a, frozenset()), sets.get(b, frozenset())))
    pairs = {(comp[t or ""], c) for t, c in got}
    assert len(got) == docs.count() and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_similar_texts(spark, odd_docs):
    """A large group that one change at a time leads away from its first member; pairs just above and below 0.8."""
    r = random.Random(5)
    texts = [t for n, changes in ((300, 3), (300, 6), (120, 3), (60, 1), (400, 12)) for _ in range(8) for t in edited(r, n, changes)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(60):
        chain[(i * 37) % 120] = f"d{i}"
        texts.append(" ".join(chain))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    check(spark, docs.union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 5000, "text")))
    check(spark, docs.limit(0))


def test_stage_drops_similar_texts(spark):
    """300 words with 3 replaced: similarity 0.9, but mostly more than 4 bits apart."""
    r = random.Random(6)
    rows = [(2 * i + j, t, "en", "s", len(t)) for i in range(20) for j, t in enumerate(edited(r, 300, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()) == list(range(0, 40, 2))


def test_stage_keeps_a_row_of_each_component(spark):
    """Null doc_ids, one doc_id with two texts, and copies of a text under and without a doc_id."""
    r = random.Random(8)
    t = [edited(r, 50, 0)[0] for _ in range(6)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (None, t[2]), (5, t[2]), (7, t[3]), (7, t[4]), (7, t[4]), (3, t[4]), (9, t[5]), (9, t[5])]
    docs = spark.createDataFrame([(d, x, "en", "s", len(x)) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted([(None, t[0]), (None, t[1]), (5, t[2]), (7, t[3]), (3, t[4]), (9, t[5])], key=str)


def test_groups_in_tiles_and_cells(spark, odd_docs, monkeypatch):
    """The same components where every group is cut into many tiles and every first member is hot."""
    monkeypatch.setattr(copies, "TILE", 3)
    for module in (common, copies):
        monkeypatch.setattr(module, "CELL", 2)
        monkeypatch.setattr(module, "HOT", 1000)
    r = random.Random(9)
    texts = [t for n, changes in ((200, 3), (60, 1)) for _ in range(4) for t in edited(r, n, changes)]
    common_words = [f"c{i}" for i in range(150)]
    for i in range(50):
        # Alike in pairs, and alike enough to the others to share bands without a link.
        words = list(common_words)
        for at in range(i // 2 % 5, 150, 19):
            words[at] = f"d{i // 2}-{at}"
        texts.append(" ".join([*words, f"e{i}"]))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    check(spark, docs)


def test_shingle_sets():
    assert len(copies.shingle_set(None)) == len(copies.shingle_set(" \t\n")) == 0
    assert len(copies.shingle_set("a b c")) == 1 and copies.shingle_set("a b c")[0] != copies.shingle_set("a b c c")[0]
    assert (copies.shingle_set("A b  c d e f") == copies.shingle_set("a B c d\te f")).all()
    long = " ".join(f"{i % 7000}" for i in range(20_000)) + " " + "x" * 1000
    assert len(copies.shingle_set(long)) == 7001 and len(copies.bands(copies.shingle_set(long))) == copies.BANDS


def test_members_with_a_likely_partner():
    """Blocks that end within a batch, fill one or run over several, against a look at every pair; no rows at all."""
    r = random.Random(3)
    rows = sorted((b, at, at % 3 if b % 2 else 7, r.choice((60, 100)), r.choice((0, (1 << 24) - 1, (1 << 25) - 1))) for b, n in enumerate((1, 2, 9, 5, 1, 30, 4)) for at in range(n))
    near = lambda x, y: x[0] == y[0] and x[2] != y[2] and min(x[3], y[3]) >= 0.8 * max(x[3], y[3]) and (x[4] ^ y[4]).bit_count() <= copies.APART
    want = [x[:2] for x in rows if any(near(x, y) for y in rows)]
    names = ["block", "_at", "root", "_size", "_fp"]
    for step in (1, 3, 10, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows[i : i + step]], pa.schema([(n, pa.int64()) for n in names])) for i in range(0, len(rows), step)]
        assert [(x["block"], x["_at"]) for b in copies._hopeful(0.8)(iter(batches)) for x in b.to_pylist()] == want
    assert want and [b.num_rows for b in copies._hopeful(0.8)(iter([]))] == [0]


def test_simhash_proposes(spark):
    """The balls alone: components of all fingerprints within 4 bits, copies of a fingerprint included; sizes far apart do not meet."""
    r = random.Random(11)
    fps = [r.getrandbits(64) for _ in range(40)]
    for at in range(120):
        fps.append(fps[r.randrange(len(fps))] ^ sum(1 << b for b in r.sample(range(64), at % 7)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    each = spark.createDataFrame([(i, 100, x) for i, x in enumerate(signed)], "_at long, _size int, _fp long")
    got = {tuple(x) for x in copies.in_balls(common.cut(each, "each")).collect()}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4
    assert components(range(160), lambda a, b: (a, b) in got or (b, a) in got) == components(range(160), near)
    apart = spark.createDataFrame([(0, 100, 5), (1, 79, 5), (2, 80, 5), (3, 79, 4)], "_at long, _size int, _fp long")
    assert {tuple(x) for x in copies.in_balls(common.cut(apart, "apart")).collect()} == {(0, 2)}
