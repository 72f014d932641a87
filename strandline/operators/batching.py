"""Batch plans: group chunks, greedy packing, splits and sequential batches.

A plan is a table (batch_id, slot, row_index). Greedy packing is sequential, but it
sees of a chunk only its size, and sizes are few: the driver runs it over counts of
sizes, and a chunk or leftover finds its batch from its place in the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.scratch import cut, numbered


def order_key(column: str, shuffle: bool, seed: int) -> list[Column]:
    """Rows in their own order, or in one that depends on the seed alone."""
    return [F.xxhash64(F.lit(seed), F.col(column)), F.col(column)] if shuffle else [F.col(column)]


def chunk_length(batch_size: int) -> int:
    return max(2, batch_size // 2)


def group_chunks(rows: DataFrame, batch_size: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """row_index, group_key, chunk (from 0; null for a leftover) and chunk_size.

    Groups are walked in chunks of max(2, batch_size // 2); a last chunk of one
    row is a leftover. A row without semantic_key is a group of its own. Ranks in
    a group come from one numbering of all rows, so a large group is dealt over
    many tasks.
    """
    m = chunk_length(batch_size)
    keyed = rows.select("row_index", F.when(F.col("semantic_key").isNull(), F.concat(F.lit("row:"), F.col("row_index"))).otherwise(F.concat(F.lit("key:"), F.col("semantic_key"))).alias("group_key"))
    placed = numbered(keyed, [F.col("group_key"), *order_key("row_index", shuffle, seed)], "at")
    groups = placed.groupBy("group_key").agg(F.min("at").alias("start"), F.count("*").alias("group_size"), F.min("row_index").alias("group_first"))
    ranked = placed.join(groups, "group_key").withColumn("rank", F.col("at") - F.col("start"))
    chunk = F.floor(F.col("rank") / m)
    size = F.least(F.lit(m), F.col("group_size") - chunk * m)
    return ranked.select("row_index", "group_key", "group_first", "rank", F.when(size >= 2, chunk).cast("long").alias("chunk"), F.when(size >= 2, size).otherwise(1).cast("long").alias("chunk_size"))


@dataclass
class Run:
    """Items from ``start`` on go ``per`` to a batch, from ``batch`` and ``slot`` on, ``width`` slots each."""

    start: int
    n: int
    per: int
    batch: int
    slot: int
    width: int


def next_fit(sizes: dict[int, int], leftovers: int, batch_size: int, drop_last: bool) -> tuple[list[Run], list[Run], int]:
    """Runs of chunks and of leftovers, and the number of batches, from counts of chunk sizes.

    Chunks come largest first and fill a batch while they fit. A batch that the
    next chunk would overfill is topped up from the end of the leftovers and
    closed, and so is the last one, even if no chunk is in it; with drop_last it
    is dropped, wherever it stands, unless that fills it. A chunk as large as a batch is one. What is left of the leftovers at the
    end makes batches from their front. Runs count chunks in order and leftovers
    from the end; a run that is dropped is not listed.
    """
    chunks: list[Run] = []
    tops: list[Run] = []
    batches = used = seen = 0
    pending: list[Run] = []
    fill = 0

    def close(n: int = 1) -> None:
        """Close n batches that are filled alike, pending among them; an empty one only from leftovers."""
        nonlocal batches, used, fill, pending
        while n > 0 and (fill or leftovers > used):
            room = batch_size - fill
            rich = (leftovers - used) // room if room else n
            some = min(n, rich) if rich else 1
            top = room if rich else leftovers - used
            if fill + top == batch_size or not drop_last:
                for r in pending:
                    chunks.append(Run(r.start, some * r.per, r.per, batches, r.slot, r.width))
                if top:
                    tops.append(Run(used, some * top, top, batches, fill, 1))
                batches += some
            used += some * top
            for r in pending:
                r.start += some * r.per
            n -= some
        pending, fill = [], 0

    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        if fill:
            some = min(left, (batch_size - fill) // size)
            if some:
                pending.append(Run(seen, some, some, 0, fill, size))
                seen, left, fill = seen + some, left - some, fill + some * size
            if left:
                close()
        if left and size == batch_size:
            chunks.append(Run(seen, left, 1, batches, 0, size))
            batches, seen = batches + left, seen + left
        elif left:
            per = batch_size // size
            whole = (left - 1) // per
            if whole:
                pending, fill = [Run(seen, per, per, 0, 0, size)], per * size
                close(whole)
                seen, left = seen + whole * per, left - whole * per
            pending, fill = [Run(seen, left, left, 0, 0, size)], left * size
            seen += left
    close()
    rest = leftovers - used
    kept = rest // batch_size * batch_size if drop_last else rest
    if kept:
        # From the front: leftover i of the rest is number leftovers - 1 - i from the end.
        tops.append(Run(leftovers - rest, -kept, batch_size, batches, 0, 1))
        batches += -(-kept // batch_size)
    return chunks, tops, batches


def _place(items: DataFrame, runs: list[Run]) -> DataFrame:
    """items (number and others) that a run takes, with batch_id and slot instead of number."""
    table = np.array([(r.start, r.n, r.per, r.batch, r.slot, r.width) for r in runs], np.int64).reshape(-1, 6)
    table = table[np.argsort(table[:, 0])]
    shared = items.sparkSession.sparkContext.broadcast(table)
    names = [c for c in items.columns if c != "number"]
    kinds = dict(items.dtypes)

    def run(batches):
        t = shared.value
        for batch in batches:
            number = batch.column("number").to_numpy(zero_copy_only=False)
            k = np.searchsorted(t[:, 0], number, side="right") - 1
            ok = (k >= 0) & (number < t[k, 0] + t[k, 1]) if len(t) else np.zeros(len(number), bool)
            k, i = k[ok], number[ok] - t[k[ok], 0]
            kept = batch.filter(pa.array(ok))
            batch_id, slot = t[k, 3] + i // t[k, 2], t[k, 4] + i % t[k, 2] * t[k, 5]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(batch_id), pa.array(slot)], names=[*names, "batch_id", "slot"])

    return items.select(*names, "number").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", batch_id long, slot long")


def plan_batches(rows: DataFrame, batch_size: int, shuffle: bool = False, drop_last: bool = False, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Group-preserving plan of rows (row_index, semantic_key).

    Chunks go largest first, in order of their group's first row. Shuffling is by
    hash of seed + epoch: the same for the same seed, and another for each epoch.
    """
    if batch_size < 2:
        raise ValueError("batch_size must be at least 2")
    spark, m, seed = rows.sparkSession, chunk_length(batch_size), seed + epoch
    chunked = cut(group_chunks(rows, batch_size, shuffle, seed), "chunks")
    whole, single = chunked.where("chunk is not null"), chunked.where("chunk is null")
    heads = whole.where(F.col("rank") % m == 0).select("group_key", "chunk", "group_first", "chunk_size")
    sizes = {r["chunk_size"]: r["count"] for r in heads.groupBy("chunk_size").count().collect()}
    n_single = single.count()
    runs, tops, n_batches = next_fit(sizes, n_single, batch_size, drop_last)
    first = order_key("group_first", shuffle, seed)
    planned = []
    if sizes:
        at = numbered(heads, [-F.col("chunk_size"), *first, F.col("chunk")])
        found = _place(at.select("group_key", "chunk", "number"), runs)
        planned.append(whole.join(found, ["group_key", "chunk"]).select("batch_id", (F.col("slot") + F.col("rank") - F.col("chunk") * m).alias("slot"), "row_index"))
    if n_single:
        at = numbered(single.select("row_index", "group_first"), first).select("row_index", "number")
        back = [r for r in tops if r.n > 0]
        planned.append(_place(at.withColumn("number", n_single - 1 - F.col("number")), back).select("batch_id", "slot", "row_index"))
        front = [Run(0, -r.n, r.per, r.batch, r.slot, r.width) for r in tops if r.n < 0]
        if front:
            planned.append(_place(at, front).select("batch_id", "slot", "row_index"))
    out = planned[0] if planned else spark.createDataFrame([], "batch_id long, slot long, row_index long")
    for p in planned[1:]:
        out = out.unionByName(p)
    if shuffle:
        moved = numbered(spark.range(n_batches).withColumnRenamed("id", "batch_id"), order_key("batch_id", True, seed), "to")
        out = out.join(moved, "batch_id").select(F.col("to").alias("batch_id"), "slot", "row_index")
    return out


def plan_length(rows: DataFrame, batch_size: int, drop_last: bool = False) -> int:
    """Number of batches; shuffling does not change it, as it depends on sizes alone."""
    m = chunk_length(batch_size)
    chunked = group_chunks(rows, batch_size).select("chunk", "chunk_size", "rank").where((F.col("rank") % m == 0) | F.col("chunk").isNull())
    counts = chunked.groupBy(F.col("chunk").isNull().alias("single"), "chunk_size").count().collect()
    return next_fit({r["chunk_size"]: r["count"] for r in counts if not r["single"]}, sum(r["count"] for r in counts if r["single"]), batch_size, drop_last)[2]


def sequential_batches(rows: DataFrame, batch_size: int, row: str = "row_index") -> DataFrame:
    """Contiguous batches by position."""
    at = F.col(row)
    return rows.select(F.floor(at / batch_size).cast("long").alias("batch_id"), (at % batch_size).cast("long").alias("slot"), at.cast("long").alias("row_index"))


def plan_loader(rows: DataFrame, batch_size: int, shuffle: bool, group_by_semantic: bool, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Grouped batches only if both grouping and shuffling are asked for."""
    if group_by_semantic and shuffle:
        return plan_batches(rows, batch_size, shuffle=True, seed=seed, epoch=epoch)
    at = numbered(rows.select("row_index"), order_key("row_index", shuffle, seed + epoch), "at")
    return at.select(F.floor(F.col("at") / batch_size).cast("long").alias("batch_id"), (F.col("at") % batch_size).alias("slot"), "row_index")


def split(rows: DataFrame, val_fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Training and validation rows of exact sizes; no validation if the fraction is 0 or less."""
    if val_fraction <= 0:
        return rows, None
    n = rows.count()
    n_val = max(1, int(n * val_fraction))
    if n - n_val <= 0:
        raise ValueError("no rows are left to train on")
    at = numbered(rows, order_key("row_index", True, seed), "_number")
    return at.where(F.col("_number") < n - n_val).drop("_number"), at.where(F.col("_number") >= n - n_val).drop("_number")
