"""Label columns with gaps: alias resolution, presence masks and dense codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.schema import ALIASES


def first_present(raw: Column, name: str) -> Column:
    """A logical field of a JSON row, as text: the first of its names that is a key.

    A key whose value is null shadows later names, which ``coalesce`` would not.
    """
    keys = F.from_json(raw, "map<string,string>")
    out = F.lit(None).cast("string")
    for alias in reversed(ALIASES[name]):
        out = F.when(F.map_contains_key(keys, alias), F.get(F.array(keys[alias]), F.lit(0))).otherwise(out)
    return out


def optional_column(rows: DataFrame, column: str, default: float = 0.0, batch: str = "batch_id") -> DataFrame:
    """column with gaps filled, column_mask, and column_present: whether its batch has any."""
    present = F.col(column).isNotNull()
    in_batch = F.max(present).over(Window.partitionBy(batch))
    return rows.withColumns({f"{column}_mask": present, f"{column}_present": in_batch, column: F.coalesce(F.col(column), F.lit(default).cast(dict(rows.dtypes)[column]))})


def encode_ids(rows: DataFrame, column: str, batch: str = "batch_id", row: str = "row_index") -> DataFrame:
    """rows with code (from 1, by first appearance in the batch; 0 if missing) and present."""
    first = F.min(row).over(Window.partitionBy(batch, column))
    rank = F.dense_rank().over(Window.partitionBy(batch).orderBy(F.col(column).isNull(), "_first"))
    present = F.col(column).isNotNull()
    return rows.withColumn("_first", first).withColumns({"code": F.when(present, rank).otherwise(0).cast("long"), "present": present}).drop("_first")
