"""SimHash near copies: texts whose sets of shingles have a Jaccard similarity of ``LEAST`` or more.

SimHash proposes fingerprints of the shingle sets that meet in the balls of ``simhash.py``
(within 4 bits). At 0.8 fingerprints differ in 10 of 64 bits on average, which no ball
that can be listed reaches, so MinHash bands propose the rest: a pair at exactly 0.8 shares
none of ``BANDS`` bands of ``DEPTH`` minima in 6 of 10 million cases, a closer pair
less often. Each member of a band is held against its first member: sizes and
SimHash (over ``APART`` bits: less than 3 in a million at 0.8) reject most chance
meetings, the texts of the others are compared. Where members are still in different
components, the band is cut into tiles of about ``TILE`` members, and a task compares
two tiles by counts of common shingles and returns a forest; tiles that lie in one
component need not meet, nor members without one of another component that sizes and
SimHash let be similar. So no group is expanded into rows of pairs, and none is ever
held whole by a task. Every link is verified on the sets of shingles, whose members are
told apart by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import CELL, HOT, connected_components, cut, drop, join_hot, only, plus, small_batches, stars
from strandline.llm.simhash import SEED, links, majority

WORDS, LEAST = 5, 0.8
BANDS, DEPTH, APART = 36, 5, 24
#: Shingles permuted at once; bounds the memory of long texts.
STEP = 1024
#: Rows of one or two texts in an Arrow batch.
BATCH = 256
#: Members of a band in a tile, about.
TILE = 256
#: Words whose hashes a Python worker remembers, and bytes of the longest of them.
KNOWN, LONGEST = 1 << 17, 64

_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 31, (BANDS * DEPTH, 1), "u4") * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, (BANDS * DEPTH, 1), "u4")
_ODD, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


class _Hashes(dict):
    """XXH64 of words, remembered until there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different k-word shingles; of all words where they are fewer, of none for none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    hashes = np.fromiter(map(_HASHES.__getitem__, words), "u8", len(words))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, "u8")
    for i in range(size):
        out = (out ^ hashes[i : i + len(out)]) * _ODD
        out ^= out >> _HALF
    return np.unique(out)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of a set's minima; none for the empty set."""
    import xxhash

    if not len(hashes):
        return []
    high = (hashes >> _HALF).astype("u4")
    least = np.min([(high[at : at + STEP] * _TIMES + _PLUS).min(1) for at in range(0, len(high), STEP)], axis=0)
    rows = least.astype("<u4").reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], "u8").view("i8").tolist()


def shingled(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """docs with _node (hash of the shingle set), _size, _fp (its SimHash) and _bands; null texts are empty."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index("text"), [*docs.columns, "_node", "_size", "_fp", "_bands"]

    def run(batches):
        import xxhash

        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(at).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "u8").view("i8")
            fp = np.array([majority(s) for s in sets], "u8").view("i8")
            more = [pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return docs.mapInArrow(run, plus(docs.schema, "_node long, _size int, _fp long, _bands array<long>"))


def verified(pairs: DataFrame, texts: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """Those of the pairs (a, b) whose texts, by _at, are similar enough.

    pairs is a table without repeats in which b has few partners. Texts in no pair are not
    sent. The last join is on a, so the text of a is sent once for all of its pairs, or
    for each cell of them where a has very many; there are fewer than HOT such texts.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    limit = counts.agg(F.greatest(F.lit(float(CELL)), F.sum("_n") / HOT)).scalar()
    hot = F.broadcast(counts.where(F.col("_n") > limit).select("a", F.ceil(F.col("_n") / limit).cast("int").alias("_cells")))
    cells = F.coalesce("_cells", F.lit(1))
    right = pairs.join(hot, "a", "left").withColumn("_cell", F.pmod(F.hash("b"), cells)).join(only(texts, pairs.select("b")).select(F.col("_at").alias("b"), F.col("text").alias("y")), "b")
    left = only(texts, pairs.select("a")).select(F.col("_at").alias("a"), F.col("text").alias("x")).join(hot, "a", "left")
    left = left.select("a", F.explode(F.sequence(F.lit(0), cells - 1)).alias("_cell"), "x")
    both = right.join(left, ["a", "_cell"]).select("a", "b", "x", "y")

    def run(batches):
        was, first = None, None
        for batch in batches:
            near = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != was:
                    was, first = a, shingle_set(x, k)
                second = shingle_set(y, k)
                shared = len(np.intersect1d(first, second, assume_unique=True))
                near.append(shared >= least * (len(first) + len(second) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    spark = pairs.sparkSession
    small_batches(spark, BATCH)
    out = cut(both.mapInArrow(run, "a long, b long"), "similar")
    small_batches(spark)
    return out


def likely(least: float) -> Column:
    """Whether two members (_size and _fp, size and fp) can be similar enough, by size and SimHash."""
    small, large = F.least("_size", "size"), F.greatest("_size", "size")
    return (small >= large * least - 1e-9) & (F.bit_count(F.col("_fp").bitwiseXOR(F.col("fp"))) <= APART)


def _similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i > j of the sets that are similar enough, counted shingle by shingle."""
    size = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(at, kind="stable")
    begins = np.append(0, np.cumsum(np.bincount(at)))
    ends, a, b = np.cumsum(size), [], []
    for i in range(1, len(sets)):
        mine = at[ends[i] - size[i] : ends[i]]
        seen = np.concatenate([owner[order[begins[t] : begins[t + 1]]] for t in mine])
        shared = np.bincount(seen[seen < i], minlength=i)
        j = np.flatnonzero(shared >= least * (size[i] + size[:i] - shared) - 1e-9)
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _meet(k: int, least: float):
    def run(batches):
        """Rows sorted by key: links within each group, as a forest."""

        def links(ids, sets):
            i, j = _similar(sets, least)
            a, b = stars(np.array(ids)[i], np.array(ids)[j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        was, ids, sets = None, [], []
        for batch in batches:
            for key, at, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if key != was and ids:
                    yield links(ids, sets)
                    ids, sets = [], []
                was = key
                ids.append(at)
                sets.append(shingle_set(text, k))
        if ids:
            yield links(ids, sets)

    return run


def _hopeful(least: float):
    """Rows of a block together: those that are likely similar to a row of another root."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 5

        def work(rows, until):
            block, at, root, size, fp = (x[:until] for x in rows)
            begins = np.flatnonzero(np.diff(block, prepend=-1))
            keep = np.zeros(len(block), bool)
            for s, e in zip(begins.tolist(), np.append(begins, len(block))[1:].tolist(), strict=True):
                n = size[s:e]
                may = (root[s:e, None] != root[s:e]) & (np.minimum.outer(n, n) >= np.maximum.outer(n, n) * least - 1e-9)
                keep[s:e] = (may & (np.bitwise_count((fp[s:e, None] ^ fp[s:e]).view("u8")) <= APART)).any(1)
            return pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(at[keep])], names=["block", "_at"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for c, x in enumerate(held)]
            others = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            last = int(others[-1]) + 1 if len(others) else 0
            yield work(held, last)
            held = [x[last:] for x in held]
        yield work(held, len(held[0]))

    return run


def tiled(members: DataFrame) -> DataFrame:
    """Rows block, _at, root, _size, _fp: the members (key and these) of two tiles, or of one, that have to meet.

    Within a key, a root of more than TILE members has tiles of its own, and the others
    share tiles. Two members of one key and different roots meet in some block. members
    is a table; work grows with the pairs of tiles of a key that differ in root.
    """
    sizes = cut(members.groupBy(F.struct("key", "root").alias("group")).agg(F.count("*").alias("_n")), "groups")
    large = sizes.where(F.col("_n") > TILE).select("group", F.col("group.root").alias("own"), F.ceil(F.col("_n") / TILE).cast("int").alias("cells"))
    small = cut(sizes.where(F.col("_n") <= TILE).select("group", "group.key", "_n"), "small")
    shared = small.groupBy("key").agg(F.ceil(F.sum("_n") / TILE).cast("int").alias("cells"))
    # Rows have the number 0 or more, so -1 is no root.
    tile = large.unionByName(join_hot(small, shared, "key").select("group", F.lit(-1).cast("long").alias("own"), "cells"))
    told = join_hot(members.withColumn("group", F.struct("key", "root")), tile, "group", sizes)
    part = F.pmod(F.hash(F.when(F.col("own") < 0, F.col("root")).otherwise(F.col("_at"))), F.col("cells"))
    told = cut(told.select("key", "own", part.alias("part"), "_at", "root", "_size", "_fp"), "told")
    tiles = told.select("key", F.struct("own", "part").alias("tile")).distinct()
    other = tiles.withColumnRenamed("tile", "other")
    differ = (F.col("tile.own") != F.col("other.own")) | (F.col("tile.own") < 0)
    blocks = cut(tiles.join(other, "key").where((F.col("tile") <= F.col("other")) & differ).withColumn("block", F.monotonically_increasing_id()), "blocks")
    side = [blocks.select("block", "key", f"{c}.own", f"{c}.part") for c in ("tile", "other")]
    return told.join(side[0].union(side[1]).distinct(), ["key", "own", "part"]).select("block", "_at", "root", F.col("_size").cast("long"), "_fp")


def in_balls(each: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) by _at that SimHash proposes, as a table: fingerprints that are equal or meet in a ball.

    Without the sizes' say these pairs have the components of all fingerprints within 4
    bits. a is the hub of its pairs; each has _at, _size and _fp, and is a table.
    """
    counts = cut(each.groupBy("_fp").agg(F.count("*").alias("_n"), F.min(F.struct("_at", "_size")).alias("first")), "fps")
    heads = counts.select("_fp", F.col("first._at").alias("a"), F.col("first._size").alias("size"), F.col("_fp").alias("fp"))
    same = join_hot(each.select("_at", "_size", "_fp"), heads, "_fp", counts.select("_fp", "_n")).where("_at != a")
    # Links lead from each fingerprint to the smallest of its task's component.
    ball = cut(links(counts.select(F.col("_fp").alias("fp"))).select(F.col("a").alias("_fp"), F.col("b").alias("fp")).distinct(), "balls")
    members = counts.select("_fp", F.col("first._at").alias("_at"), F.col("first._size").alias("_size"))
    other = join_hot(cut(ball.join(members, "_fp"), "members"), heads.drop("_fp"), "fp")
    names = ["a", F.col("_at").alias("b")]
    return cut(same.where(likely(least)).select(*names).union(other.where(likely(least)).select(*names)).distinct(), "proposed")


def near_copies(docs: DataFrame, k: int = WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with _at (their number) and _node, and the table _node, component.

    Components are numbered by one of their rows. Texts without words are one node.
    """
    rows = cut(shingled(docs, k).withColumn("_at", F.monotonically_increasing_id()), "shingled")
    nodes = cut(rows.groupBy("_node").agg(F.min("_at").alias("_at")), "nodes")
    each = cut(only(rows.select("_at", "_size", "_fp", "_bands"), nodes.select("_at")), "each")
    placed = each.select(F.explode("_bands").alias("key"), "_at", "_size", "_fp")
    firsts = cut(placed.groupBy("key").agg(F.count("*").alias("_n"), F.min("_at").alias("first")).where("_n > 1"), "firsts")
    met = cut(join_hot(placed, firsts.drop("_n"), "key", firsts).where("_at != first"), "met")
    to_first = cut(met.select("first", F.col("_at").alias("b"), "_size", "_fp").distinct(), "to_first")
    heads = each.select(F.col("_at").alias("first"), F.col("_size").alias("size"), F.col("_fp").alias("fp"))
    in_bands = join_hot(to_first, heads, "first").where(likely(least)).select(F.col("first").alias("a"), "b")
    pairs = cut(in_balls(each, least).union(in_bands).distinct(), "pairs")
    drop(each)
    known = connected_components(verified(pairs, rows, k, least), "a", "b")
    # What the first members did not bring together meets in tiles, each set of members once.
    rooted = cut(met.join(known, F.col("_at") == F.col("node"), "left").select("key", "_at", "_size", "_fp", F.coalesce("component", "_at").alias("root")), "rooted")
    drop(met)
    same = rooted.groupBy("key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_at")).alias("x"), F.sum(F.hash("_at")).alias("y"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    mixed = cut(same.groupBy("_n", "x", "y").agg(F.min("key").alias("key")).select("key", "_n"), "mixed")
    apart = cut(join_hot(rooted, mixed.select("key"), "key", mixed), "apart")
    blocks = tiled(apart).repartition("block").sortWithinPartitions("block")
    left = cut(blocks.mapInArrow(_hopeful(least), "block long, _at long"), "hopeful")
    # By number, as what a block costs is not its bytes, by which Spark would merge partitions.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = only(rows.select("_at", "text"), left.select("_at"))
    whole = left.join(texts, "_at").repartition(parts, "block").sortWithinPartitions("block", "_at").select("block", "_at", "text")
    small_batches(docs.sparkSession, BATCH)
    within = cut(whole.mapInArrow(_meet(k, least), "a long, b long"), "within")
    small_batches(docs.sparkSession)
    found = connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(within), "a", "b")
    member = nodes.join(found, F.col("_at") == F.col("node"), "left").select("_node", F.coalesce("component", "_at").alias("component"))
    return rows, member
