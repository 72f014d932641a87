"""Helpers shared by the corpus operators: row access, joins on hot keys, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.scratch import cut, drop

__all__ = ["connected_components", "cut", "drop", "join_hot", "only", "plus", "small_batches", "stars", "table"]

#: Links that a task holds while it contracts them.
HELD = 1 << 19

#: Bytes counted as white space between words: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound what one Arrow batch of whole texts can hold in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def plus(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with more fields."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of a-b: each node but the smallest, to the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for where in (u, v, label[u], label[v]):
            np.minimum.at(new, where, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _contract(batches):
    """Links of a task as forests of at most HELD links each."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate((a, b)))
        if len(a) >= HELD:
            a, b = stars(a, b)
            if len(a) >= HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["x", "y"])
                a, b = a[:0], b[:0]
    a, b = stars(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["x", "y"])


def _settle(batches):
    """All links, no more than a task holds: each node and the smallest of its component."""
    links = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for b in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in links)]) for k in range(2))
    a, b = stars(a, b)
    least = np.unique(b)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, least])), pa.array(np.concatenate([b, least]))], names=["node", "component"])


#: Keys that join_hot broadcasts, at most, and rows of a key that make it hot, at least.
HOT, CELL = 10_000, 256


def join_hot(rows: DataFrame, values: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """rows with the columns of values, which has each key at most once; rows without a match go.

    Rows of a key above max(CELL, rows / HOT) never meet in one task: there are fewer
    than HOT such keys, so their values are broadcast. The others are shuffled. rows
    is read more than once and should be a table. counts: rows by key (key, _n) where
    they are known, at least those of keys with a match.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    limit = counts.agg(F.greatest(F.lit(float(CELL)), F.sum("_n") / HOT)).scalar()
    hot = counts.where(F.col("_n") > limit).select(key)
    warm = rows.join(F.broadcast(values.join(F.broadcast(hot), key, "left_semi")), key)
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(values, key)
    return warm.unionByName(cold)


def only(rows: DataFrame, numbers: DataFrame, at: str = "_at") -> DataFrame:
    """Those rows whose number (at, a long) is in numbers, a single column of longs; the rest of a row is not shuffled.

    The numbers are broadcast as sets of 64, a bit each: for numbers that stand close
    together, such as monotonically_increasing_id() gives, a row for 64 of them.
    """
    name = numbers.columns[0]
    sets = numbers.where(F.col(name).isNotNull()).groupBy(F.shiftright(name, 6).alias("_set")).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{name}` & 63 as int)))").alias("_bits"))
    held = rows.join(F.broadcast(sets), F.shiftright(at, 6) == F.col("_set"))
    return held.where(F.getbit("_bits", F.col(at).bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable: columns node, component, for nodes with a link.

    Links (longs, none null) are contracted to forests where they lie. If one task can
    hold what is left (HELD links), it settles them; rounds would cost the driver dozens
    of plans. Else minimum labels spread with pointer jumping. Each round is a join on the
    links and a partially aggregated minimum, cut to the shared folder; the
    driver sees only whether a label changed. Hubs of many links, and labels of many
    nodes, are hot keys of these joins and are spread over all tasks.
    """
    near = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).mapInArrow(_contract, "x long, y long").distinct(), "edges")
    if near.count() <= HELD:
        return cut(near.coalesce(1).mapInArrow(_settle, "node long, component long"), "labels")
    both = near.union(near.select("y", "x"))
    degree = cut(both.groupBy("y").agg(F.count("*").alias("_n")), "degree")
    labels = cut(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("label")), "labels")
    while True:
        spread = join_hot(both, labels.withColumnRenamed("x", "y"), "y", degree).select("x", "label")
        best = cut(spread.union(labels).groupBy("x").agg(F.min("label").alias("near"), F.max("label").alias("most")), "best")
        # A node's label is a node, which has a label of its own.
        jump = labels.select(F.col("x").alias("near"), F.col("label").alias("far"))
        least = F.least("near", "far")
        new = cut(join_hot(best, jump, "near").select("x", least.alias("label"), (F.col("most") > least).alias("moved")), "labels")
        moved = bool(new.where("moved").limit(1).count())
        drop(labels)
        drop(best)
        labels = new
        if not moved:
            break
        labels = new.drop("moved")
        labels._strandline_path = new._strandline_path
    drop(near)
    drop(degree)
    return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
