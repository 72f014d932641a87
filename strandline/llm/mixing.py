"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words. A document's expected copies are its
source's target over its source's size; their prefix sum within the source, plus
one random offset a source, emits the document once for each whole number that
it crosses. Documents stand in order of size, so neighbours in the prefix sum
are alike and what a source takes stays within about one longest document of its
target.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, table

SPACE = " \t\n\x0b\x0c\r"
WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, 17
#: Documents of one source and size that are ranked together, unless all documents are
#: more than HOT times as many; so at most HOT pairs of source and size are split.
CELL, HOT = 1000, 10_000


def n_words(text):
    """Number of words of a text column; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Target of each source: sizes by source; no target is above cap times its size.

    Sources take the weights in turn, by code point, null last. What a capped
    source cannot take is shared anew among the others by weight.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        want = {s: left * weight[s] / total for s in names if s in free}
        full = [s for s in want if want[s] > cap * sizes[s]]
        if not full:
            return out | want
        for s in full:
            out[s] = cap * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, size and any other columns) with source_size, target, copies.

    The driver gets one row a source, as the weights are given by source. Ranks
    in a source come from counts by (source, size, salt), where only frequent sizes
    have salts: no task holds a whole source, and the prefix sums of a source are over
    its different sizes, not over its documents. A null source is one source; rows
    repeated in docs are documents of their own; an empty document or source takes
    nothing, and a null size is 0. Columns of docs with the names of the three new ones
    are replaced; names that start with ``_mix`` are taken.
    """
    spark, docs = docs.sparkSession, docs.drop("source_size", "target", "copies")
    known = cut(docs.groupBy("source", F.coalesce("size", F.lit(0)).alias("size")).agg(F.count("*").alias("n")), "cells")
    per = {r["source"]: r for r in known.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()}
    goal = targets({s: r["size"] for s, r in per.items()}, weights, share, cap)
    rates = [(s, k, int(r["size"]), float(goal[s]), goal[s] / r["size"] if r["size"] else 0.0, (zlib.crc32(f"{seed}:{s}".encode()) & 0xFFFF) / 0x10000) for k, (s, r) in enumerate(per.items())]
    # One row a source, which the driver has held anyway; Spark, which cannot tell its size, would shuffle the documents.
    sources = spark.createDataFrame(rates, "_mix_source string, _mix_id int, source_size long, target double, _mix_rate double, _mix_offset double")
    limit = max(CELL, sum(r["n"] for r in per.values()) // HOT)
    named = sources.select("_mix_source", "_mix_id")
    split = known.where(F.col("n") > limit).join(named, known["source"].eqNullSafe(named["_mix_source"])).select("_mix_id", F.col("size").alias("_mix_size"), F.ceil(F.col("n") / limit).cast("int").alias("_mix_salts"))
    cell = ["_mix_id", "_mix_size", "_mix_salt"]
    placed = docs.join(F.broadcast(sources), docs["source"].eqNullSafe(sources["_mix_source"])).withColumn("_mix_size", F.coalesce("size", F.lit(0)))
    placed = placed.join(F.broadcast(split), ["_mix_id", "_mix_size"], "left").withColumn("_mix_salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("_mix_salts", F.lit(1))))
    before = Window.partitionBy("_mix_id").orderBy("_mix_size", "_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*cell).count().select(*cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mix_base"))
    # The ranks and the join share one shuffle of the documents.
    ranked = placed.withColumn("_mix_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id"))).join(cells, cell)
    rank = F.col("_mix_rank") + F.col("_mix_base")
    crossed = F.floor(rank * F.col("_mix_rate") + F.col("_mix_offset")) - F.floor((rank - 1) * F.col("_mix_rate") + F.col("_mix_offset"))
    return ranked.withColumn("copies", F.least(crossed, F.ceil("_mix_rate")).cast("long")).select(*docs.columns, "source_size", "target", "copies")


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes."""
    return mixed.where("copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_mix_copy")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
