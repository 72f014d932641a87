"""Embedding near-duplicates by epsilon grid order join.

Vectors are scaled to unit length, so a cosine of at least ``threshold`` is a
distance of at most epsilon. On the leading principal dimensions they fall into
grid cells of side epsilon; sorted by cell, the sequence is cut into intervals
(blocks). Two blocks are joined only if their boxes on the leading dimensions come
within epsilon; within two blocks, intervals are halved and joined recursively,
skipping pairs whose boxes are further apart. A projection never lengthens a
distance, so what is skipped is provably distant.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import connected_components, cut, plus, stars, table

THRESHOLD = 0.93
#: Leading principal dimensions of the grid, and vectors they are found from, at most.
LEADING, SAMPLE = 6, 10_000
#: Vectors in a block, and in the intervals that are compared outright.
BLOCK, LEAF = 1024, 128
#: Cosines so near the threshold are worked out again with exact sums.
CLOSE = 1e-11


def valid(label, vector):
    """A label, and finite numbers that are not all zero."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & numbers & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(vectors: DataFrame, leading: int = LEADING, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Leading principal directions by number of dimensions, from a bounded sample.

    They decide how much is skipped, never what is linked.
    """
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow().column("embedding").to_pylist()
    out = {}
    for size in {len(r) for r in rows}:
        x = np.array([r for r in rows if len(r) == size], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        _, axes = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
        out[size] = np.ascontiguousarray(axes[:, ::-1][:, :leading])
    return out


def _axes(known: dict[int, np.ndarray], size: int) -> np.ndarray:
    return known[size] if size in known else np.eye(size)[:, :LEADING]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


def join_blocks(a: dict, b: dict, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the links of two blocks: unit vectors u, raw vectors x, projections p."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    left, right = [], []

    def go(i, j, k, m):
        if same and m <= i:
            return
        gap = np.maximum(a["p"][i:j].min(0) - b["p"][k:m].max(0), b["p"][k:m].min(0) - a["p"][i:j].max(0))
        if (np.maximum(gap, 0) ** 2).sum() > epsilon**2:
            return
        if j - i <= LEAF and m - k <= LEAF:
            dots = a["u"][i:j] @ b["u"][k:m].T
            link = dots >= threshold
            for x, y in np.argwhere(np.abs(dots - threshold) < CLOSE):
                link[x, y] = cosine(a["x"][i + x], b["x"][k + y]) >= threshold
            x, y = np.nonzero(link)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            left.append(x)
            right.append(y)
        elif j - i >= m - k:
            h = (i + j) // 2
            go(i, h, k, m)
            go(h, j, k, m)
        else:
            h = (k + m) // 2
            go(i, j, k, h)
            go(i, j, h, m)

    go(0, len(a["u"]), 0, len(b["u"]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def blocks_of(classes: DataFrame, axes, threshold: float, block: int = BLOCK) -> DataFrame:
    """Intervals of the sequence in grid order: block, label, dims, lo, hi, nodes, sizes, vectors."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    known = classes.sparkSession.sparkContext.broadcast(axes)

    def cells(batches):
        for batch in batches:
            out = []
            for v in batch.column(batch.schema.names.index("embedding")).to_pylist():
                x = np.array(v, float)
                out.append(np.floor((x / np.sqrt((x * x).sum())) @ _axes(known.value, len(x)) / epsilon).astype("i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])

    def gather(batches):
        task, n, held = TaskContext.get().partitionId(), 0, None

        def out(rows):
            nonlocal n
            x = np.array(rows["embedding"], float)
            p = _unit(x) @ _axes(known.value, x.shape[1])
            n += 1
            return pa.RecordBatch.from_pydict(
                {"block": [task << 32 | n], "label": [rows["label"][0]], "dims": [x.shape[1]], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()], "nodes": [np.array(rows["node"], "<i8").tobytes()], "sizes": [np.array(rows["n"], "<i8").tobytes()], "vectors": [x.astype("<f8").tobytes()]},
                schema=pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("nodes", pa.binary()), ("sizes", pa.binary()), ("vectors", pa.binary())]),
            )

        names = ("label", "node", "n", "embedding")
        for batch in batches:
            for label, node, size, v in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in names), strict=True):
                if held and (held["label"][0] != label or len(held["embedding"][0]) != len(v) or len(held["node"]) >= block):
                    yield out(held)
                    held = None
                held = held or {c: [] for c in names}
                for c, value in zip(names, (label, node, size, v), strict=True):
                    held[c].append(value)
        if held:
            yield out(held)

    schema = plus(classes.schema, "cell array<int>")
    ordered = classes.mapInArrow(cells, schema).withColumn("_dims", F.size("embedding")).repartitionByRange("label", "_dims", "cell", "node").sortWithinPartitions("label", "_dims", "cell", "node")
    return ordered.mapInArrow(gather, "block long, label long, dims int, lo array<double>, hi array<double>, nodes binary, sizes binary, vectors binary")


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with a <= b of blocks of one label whose boxes come within epsilon."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    boxes = blocks.select("block", "label", "dims", "lo", "hi")
    cell = lambda c: F.floor(F.get(c, F.lit(0)) / epsilon)
    a = boxes.select(F.col("block").alias("a"), "label", "dims", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    b = boxes.select(F.col("block").alias("b"), "label", "dims", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, ["label", "dims", "cell"]).where((F.col("a") <= F.col("b")) & (far <= epsilon**2)).select("a", "b").distinct()


def link(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root, links) of classes (label, embedding, node, n) of equal vectors.

    A row says that in one pair of blocks the node links with ``links`` vectors of
    other classes and is connected with root; no pair of vectors becomes a row.
    """
    spark = classes.sparkSession
    axes = directions(classes)
    known = spark.sparkContext.broadcast(axes)
    blocks = cut(blocks_of(classes, axes, threshold), "blocks")
    pairs = block_pairs(blocks, threshold)
    side = lambda k: blocks.select(F.col("block").alias(k), F.col("dims").alias(f"dims_{k}"), F.col("nodes").alias(f"nodes_{k}"), F.col("sizes").alias(f"sizes_{k}"), F.col("vectors").alias(f"vectors_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims_a"]
                part = []
                for k in "ab":
                    x = np.frombuffer(row[f"vectors_{k}"], "<f8").reshape(-1, dims)
                    u = _unit(x)
                    part.append({"x": x, "u": u, "p": u @ _axes(known.value, dims), "node": np.frombuffer(row[f"nodes_{k}"], "<i8"), "n": np.frombuffer(row[f"sizes_{k}"], "<i8")})
                a, b = part
                i, j = join_blocks(a, b, threshold, row["a"] == row["b"])
                nodes = np.concatenate([a["node"][i], b["node"][j]])
                who, at = np.unique(nodes, return_inverse=True)
                links = np.bincount(at, np.concatenate([b["n"][j], a["n"][i]]), len(who)).astype(np.int64)
                x, y = stars(a["node"][i], b["node"][j])
                root = who.copy()
                root[np.searchsorted(who, x)] = y
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(root), pa.array(links)], names=["node", "root", "links"])

    # A row holds two blocks; few rows at a time bound the worker's memory.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        return cut(both.mapInArrow(run, "node long, root long, links long"), "links")
    finally:
        spark.conf.set(key, was)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links and component_id of every row.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least threshold. Null, zero and non-finite vectors,
    and vectors of other length, link with nothing; their component is their own
    vec_id. Equal vectors are one node with a size, so copies are never paired.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    good = rows.where(valid(F.col("label"), F.col("embedding")))
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = link(classes.select("label", "embedding", "node", "n"), threshold)
    component = connected_components(found.where("root <> node"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "first", "n").join(links, "node", "left").join(component, "node", "left")
    known = known.select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = cut(known.join(lowest, "root").select("node", "n_links", "component_id"), "nodes")
    by_vector = classes.join(by_node, "node").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "n_links", "component_id")
    out = rows.join(by_vector, (rows["label"] == by_vector["_label"]) & (rows["embedding"] == by_vector["_embedding"]) & valid(rows["label"], rows["embedding"]), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
