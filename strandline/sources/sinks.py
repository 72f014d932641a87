"""JSON-lines output of scored trajectories."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched(trajectories: DataFrame, report: DataFrame) -> DataFrame:
    """row_index and value: each input object with its clir_* fields put in.

    Keys that the engine does not know pass through as they were.
    """
    fields = [c for c in report.columns if c.startswith("clir_")]
    joined = trajectories.select("row_index", "raw").join(report.select("row_index", *fields), "row_index")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            columns = {f: batch.column(k + 2).to_pylist() for k, f in enumerate(fields)}
            for i, raw in enumerate(batch.column(1).to_pylist()):
                row = json.loads(raw) if raw else {}
                row.update({f: columns[f][i] for f in fields})
                values.append(json.dumps(row, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], names=["row_index", "value"])

    return joined.mapInArrow(merge, "row_index long, value string")


def write_jsonl(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """One object a line, in order of row_index.

    Sorted files by default: in order of their names they are the whole. One
    file runs through one task; ask for it only where the result is small.
    """
    ordered = lines.coalesce(1).sortWithinPartitions("row_index") if one_file else lines.orderBy("row_index")
    ordered.select("value").write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """JSON lines of any table; nulls are written."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
