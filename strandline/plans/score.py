"""Score candidates and pick the best of each query: read, evaluate, select, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import forward, selection
from strandline.sources import sinks
from strandline.sources.trajectories import read_trajectories


def score(spark: SparkSession, data: str, checkpoint: str, feature_root: str | None = None, onset_threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Trajectories and their reports.

    Scores do not depend on how rows are batched, so there are no batches; the
    one shuffle of the whole is the choice by query_id.
    """
    params, config = forward.load(spark, checkpoint)
    rows = read_trajectories(spark, data, feature_root)
    return rows, selection.score_report(forward.forward(rows, params, config), onset_threshold)


def run(spark: SparkSession, data: str, checkpoint: str, output: str, feature_root: str | None = None, onset_threshold: float = 0.5) -> None:
    rows, report = score(spark, data, checkpoint, feature_root, onset_threshold)
    sinks.write_jsonl(sinks.enriched(rows, report), output)
