"""Document fingerprints: Merkle trees over paragraphs and sections.

Paragraphs are lines, sections are ``SECTION`` lines in a row. A paragraph is cut into
pieces of a few words, whose ends depend on the words alone, so that they fall into
step again after an edit. A piece's node is the SHA-256 of its text, and every node
above that of the nodes below it, up to the root: equal roots mean equal texts, and
where roots differ, the sections, paragraphs and pieces that differ say where. Two
trees are alike by the pieces that their differing branches do not have in common.
Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import spans as S
from strandline.llm.common import cut, table

SECTION = 8
#: A piece ends after the first word, from its fourth, whose last character is one of
#: these (every third of a-z and 0-9), after 16 words, or with its paragraph.
ENDS = "adgjmpsvy0369"
#: White space before the first word, or with no word, belongs to the piece.
PIECE = r"(?:[\x20\x09\x0B-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,3}+(?:[^\x20\x09-\x0D]++(?<![%s])[\x20\x09\x0B-\x0D]*+){0,12}+(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+)?+|[\x20\x09\x0B-\x0D]++)" % ENDS


def _node(below: Column) -> Column:
    return F.sha2(F.array_join(below, ""), 256)


def _short(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: F.xxhash64(n))


def tree(text: Column, section: int = SECTION) -> Column:
    """struct(root, sections, paragraphs, pieces) of a text; null is empty.

    root is the whole node. The others, by which branches are compared, are cut to 64
    bits: sections in order, the paragraphs of each, the pieces of each of those. A
    text has one paragraph at least, the empty one, which has no pieces.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    leaves = lambda x: F.struct(_node(F.transform(x, lambda p: F.sha2(p, 256))).alias("node"), _short(x).alias("pieces"))
    paragraphs = F.transform(lines, lambda p: S.let(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), leaves))
    joined = lambda g: F.struct(_node(g["node"]).alias("node"), _short(g["node"]).alias("paragraphs"), g["pieces"].alias("pieces"))
    grouped = lambda g: F.transform(F.sequence(F.lit(0), F.ceil(F.size(g) / section).cast("int") - 1), lambda i: S.let(F.slice(g, i * section + 1, section), joined))
    whole = lambda s: F.struct(_node(s["node"]).alias("root"), _short(s["node"]).alias("sections"), s["paragraphs"].alias("paragraphs"), s["pieces"].alias("pieces"))
    return S.let(paragraphs, lambda g: S.let(grouped(g), whole))


def _among(nodes: Column):
    """A test of membership in an array, by bisection."""
    return lambda x: S.below(nodes, x + 1, 24) > S.below(nodes, x, 24)


def _rest(a: Column, b: Column) -> Column:
    """Pieces of a in the paragraphs that differ from all of b's, in the sections that do."""
    sections = F.array_sort(F.array_except(a["sections"], b["sections"]))
    paragraphs = F.array_sort(F.array_except(F.flatten(a["paragraphs"]), F.flatten(b["paragraphs"])))
    inside = lambda z, d: F.flatten(F.transform(F.filter(F.arrays_zip(z["p"].alias("p"), z["x"].alias("x")), lambda q: _among(d["paragraphs"])(q["p"])), lambda q: q["x"]))
    branches = F.arrays_zip(a["sections"].alias("s"), a["paragraphs"].alias("p"), a["pieces"].alias("x"))
    walk = lambda d: F.flatten(F.transform(F.filter(branches, lambda z: _among(d["sections"])(z["s"])), lambda z: inside(z, d)))
    return S.let(F.struct(sections.alias("sections"), paragraphs.alias("paragraphs")), walk)


def likeness(a: Column, b: Column) -> Column:
    """One less the share of different pieces that only one tree has, 0 to 1; equal roots: 1.

    Branches that both trees have are skipped whole, wherever they stand.
    """
    leaves = lambda t: F.flatten(F.flatten(t["pieces"]))
    differ = lambda x, y: F.size(F.array_except(_rest(x, y), leaves(y)))
    total = F.size(F.array_distinct(leaves(a))) + F.size(F.array_distinct(leaves(b)))
    return F.when(a["root"] == b["root"], 1.0).when(total == 0, 0.0).otherwise((total - differ(a, b) - differ(b, a)) / total)


def differing(a: Column, b: Column, section: int = SECTION) -> Column:
    """Paragraphs of a, by number, that differ from those of b at the same place.

    Sections with equal nodes are skipped whole.
    """
    here = F.filter(F.sequence(F.lit(0), F.size(a["sections"]) - 1), lambda i: ~F.coalesce(F.get(a["sections"], i) == F.get(b["sections"], i), F.lit(False)))
    inside = lambda i: F.filter(F.transform(F.get(a["paragraphs"], i), lambda p, k: F.when(F.coalesce(p == F.get(F.get(b["paragraphs"], i), k), F.lit(False)), -1).otherwise(i * section + k)), lambda k: k >= 0)
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(F.flatten(F.transform(here, inside)))


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs and tree, which replaces a column of that name.

    A null text is empty; repeated rows come back repeated with equal trees, an empty
    table gives no rows.
    """
    return docs.withColumn("tree", tree(F.col(text_col)))


def successors(keys: DataFrame) -> DataFrame:
    """k1, k2, n1, n2 and the other columns: each key and the next; after the last, the first.

    keys: k1, k2 and any other columns, each key once. Keys are sorted by range, numbered
    within their partition and joined on the next number; only the bounds of the
    partitions, as many as there are partitions, go through the driver.
    """
    spark = keys.sparkSession
    placed = cut(keys.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2").withColumn("at", F.monotonically_increasing_id()), "order")
    bounds = sorted(tuple(r) for r in placed.groupBy(F.shiftright("at", 33)).agg(F.min("at"), F.max("at")).select("min(at)", "max(at)").collect())
    jumps = spark.createDataFrame([(hi, bounds[(i + 1) % len(bounds)][0]) for i, (_, hi) in enumerate(bounds)], "at long, jump long")
    ahead = placed.join(F.broadcast(jumps), "at", "left").select(*keys.columns, F.coalesce("jump", F.col("at") + 1).alias("next"))
    then = placed.select(F.col("at").alias("next"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    return ahead.join(then, "next").drop("next")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, edited (text) and next_tree of every row.

    edited is the text whose last floor(n_chars / 4) code points are replaced by
    the first as many (or all) of the next document's. Documents follow each
    other by doc_id, then by a hash of the text; a null doc_id stands first.
    Rows that repeat both are one document, returned as often. Null texts are
    empty.
    """
    text, least = F.coalesce("text", F.lit("")), F.lit(-(1 << 63))
    # Both sides of the plan read these three columns, so whole texts are shuffled once.
    keyed = docs.select(F.coalesce("doc_id", least).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    sizes = keyed.select("k1", "k2", F.floor(F.length("text") / 4).cast("int").alias("need"))
    order = cut(successors(sizes.groupBy("k1", "k2").agg(F.max("need").alias("need"), F.count("*").alias("n"))), "next")
    # The next document's part, once for each document before it, however often it is repeated.
    given = order.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "need", F.col("n1").alias("k1"), F.col("n2").alias("k2"))
    parts = keyed.join(given, ["k1", "k2"]).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.expr("left(text, need)").alias("part"), tree(F.col("text")).alias("next_tree"))
    repeated = order.where("n > 1").limit(1).count()
    joined = keyed.join(parts.dropDuplicates(["k1", "k2"]) if repeated else parts, ["k1", "k2"])
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.col("part"))
    return joined.select(F.nullif("k1", least).alias("doc_id"), "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_tree")


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents")).withColumns({"tree": tree(F.col("text")), "edited_tree": tree(F.col("edited"))})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )
