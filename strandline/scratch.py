"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders that go when their application ends.
_made: set[str] = set()
#: Tables that cut() wrote: weakly, the listing of files that each plan over one holds, and the path.
_listed: list[tuple] = []


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where all runs on one machine (tests).

    A local folder on a cluster would leave each executor's part on its own disk, so a
    cluster that names none is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"
    if path not in _made:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _made.add(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there.

    The files outlive lost executors, and both halves of a plan that uses the
    result twice see the same rows. Tables that no DataFrame reads any more go first.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    plan = out._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        _listed.append((spark.sparkContext._jvm.java.lang.ref.WeakReference(plan.relation().location()), path))
    return out


def sweep(spark: SparkSession) -> None:
    """Delete tables of cut() that no plan can read any more, as Spark does with its shuffles.

    All plans over a table share one listing of its files, so once the JVM has collected
    that, no DataFrame, its cache or a running query needs the files. An RDD made of a
    DataFrame does not count.
    """
    gone = [x for x in _listed if x[0].refersTo(None)]
    for x in gone:
        _listed.remove(x)
        _delete(spark, x[1])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote; only once no later plan reads it."""
    path = getattr(df, "_strandline_path", None)
    if path:
        _delete(df.sparkSession, path)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df and each row's place, from 0, in the order given, which must be total.

    Rows are sorted by range and numbered within their partition; only the sizes
    of the partitions go through the driver. No task gets more than its range,
    whatever the keys.
    """
    keys = {f"_key{i}": c for i, c in enumerate(order)}
    sort = list(keys)
    placed = cut(df.withColumns(keys).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.min("_at"), F.count("*")).collect())
    starts, total = [], 0
    for p, least, n in sizes:
        starts.append((p, total - least))
        total += n
    # As many rows as there are partitions.
    shift = df.sparkSession.createDataFrame(starts, "_part long, _shift long")
    return placed.withColumn("_part", part).join(F.broadcast(shift), "_part").select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
