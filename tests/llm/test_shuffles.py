"""What the pipeline's steps shuffle: texts only where texts have to meet."""

import random

import corpus_pipeline
import pytest

from strandline.llm import common, copies, mixing

BROAD = "spark.sql.autoBroadcastJoinThreshold"


def shuffled(df):
    """Runs df; bytes of the rows that its exchanges wrote."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    todo, total = [run.executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().get("dataSize").get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.fixture
def no_small_tables(spark):
    """As over large inputs, Spark broadcasts only what it is told to."""
    was = spark.conf.get(BROAD)
    spark.conf.set(BROAD, "-1")
    yield
    spark.conf.set(BROAD, was)


@pytest.fixture
def docs(spark):
    """Unlike long texts, and three pairs of near copies among them; two sources and none."""
    r = random.Random(12)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(2000)] for _ in range(150)]
    texts += [["x", *t[1:]] for t in texts[:3]]
    rows = [(i, " ".join(t), "en", ("a", "b", None)[i % 3], len(" ".join(t))) for i, t in enumerate(texts)]
    return common.cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")


def size(docs):
    return sum(len(r.text) for r in docs.select("text").collect())


def test_only_rows_of_some_numbers(spark):
    """Ends of sets of 64, numbers of later partitions, repeats, a null, numbers of no row; the rows' own columns in order."""
    at = [0, 1, 62, 63, 64, 65, 127, 128, (1 << 33) - 1, 1 << 33, (1 << 33) + 63, (1 << 33) + 64, 5 << 33, (1 << 62) + 63]
    rows = spark.createDataFrame([(f"t{x}", x) for x in at], "text string, _at long")
    want = [0, 63, 64, 128, 1 << 33, (1 << 33) + 63, (1 << 62) + 63]
    numbers = spark.createDataFrame([(x,) for x in [*want, *want, None, 2, 7 << 33]], "`a b` long")
    got = common.only(rows, numbers)
    assert got.columns == rows.columns and sorted(tuple(x) for x in got.collect()) == sorted((f"t{x}", x) for x in want)
    assert common.only(rows, numbers.limit(0)).count() == 0
    assert {x._at for x in common.only(rows, rows.where("_at % 2 = 1").select("_at")).collect()} == {x for x in at if x % 2}


def test_near_dedup_sends_texts_of_pairs_alone(spark, docs, no_small_tables, monkeypatch):
    sent = {}

    def seen(df, name):
        if name in ("similar", "within"):
            sent[name] = shuffled(df)
        return common.cut(df, name)

    monkeypatch.setattr(copies, "cut", seen)
    out = corpus_pipeline.keep_one_of_each(spark, docs, "")
    last = shuffled(out)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(150))
    whole = size(docs)
    assert sorted(sent) == ["similar", "within"] and sent["similar"] > 0
    assert max(*sent.values(), last) < whole / 4, (sent, last, whole)


def test_mix_sends_texts_once(spark, docs, no_small_tables):
    mixed = mixing.mix(docs.withColumn("size", mixing.n_words(docs["text"])))
    assert shuffled(mixed) < 1.5 * size(docs)
    assert mixed.count() == docs.count()
