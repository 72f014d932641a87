"""JSON-lines trajectories and their tensors.

Lines are parsed where they lie, in Arrow batches, by Python's JSON parser: it
alone keeps the difference between an absent key and a null, between 7 and "7",
and takes NaN. Tensors that a row names by path are joined from their files.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.schema import ALIASES, SCALARS, SEQUENCES, TENSORS, TRAJECTORIES

#: Keys under which a saved object may hold its tensor.
WRAPPERS = ("hidden_states", "features", "tensor", "states")


#: A character that Python's str.strip() would not take away.
_VISIBLE = r"[^\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), row_index (from 0, blank lines left out) and value, in file order.

    Splits are numbered by file and place; only their sizes are gathered.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = text.where(F.col("value").rlike(_VISIBLE)).withColumn("row", F.monotonically_increasing_id())
    splits = text.groupBy("file", "block").agg(F.min("line").alias("line_0"), F.count("*").alias("lines"))
    filled = rows.groupBy("file", "block").agg(F.min("row").alias("row_0"), F.count("*").alias("rows"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = splits.join(filled, ["file", "block"], "left").select("file", "block", "line_0", "row_0", F.coalesce(F.sum("lines").over(in_file), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    return rows.join(start, ["file", "block"]).select(
        (F.col("line") - F.col("line_0") + F.col("lines_before") + 1).alias("line_no"),
        (F.col("row") - F.col("row_0") + F.col("rows_before")).alias("row_index"),
        "value",
    )


def first_present(row: dict, names: tuple[str, ...]):
    """Value of the first name that the row has, null or not; None without one."""
    for name in names:
        if name in row:
            return row[name]
    return None


def typed_key(value) -> str | None:
    """Identity of a JSON scalar: 7, "7", 7.0 and true all differ."""
    return None if value is None else repr(value)


def number(value) -> float | None:
    return None if value is None else float(value)


def fitted(values, length: int) -> list[float] | None:
    """A label sequence cut or filled up with zeros to the trajectory's length."""
    if values is None:
        return None
    flat = np.asarray(values, float).ravel()[:length]
    return np.concatenate([flat, np.zeros(length - len(flat))]).tolist()


def inline(row: dict, name: str):
    return row.get(name)


def parse(value: str, line_no: int, row_index: int) -> dict:
    """Fields of one line but for tensors by path, and the paths of these."""
    try:
        row = json.loads(value)
        if not isinstance(row, dict):
            raise ValueError("not an object")
    except ValueError as e:
        raise ValueError(f"line {line_no}: invalid JSON: {e}") from e
    out = {"row_index": row_index, "line_no": line_no, "raw": value}
    out["id"] = str(row.get("id", row_index))
    named = any(n in row for n in ALIASES["query_id"])
    out["query_id"] = str(first_present(row, ALIASES["query_id"]) if named else row_index)
    out["semantic_key"] = typed_key(first_present(row, ALIASES["semantic_id"]))
    out["style_key"] = typed_key(first_present(row, ALIASES["style_id"]))
    for name in SCALARS:
        out[name] = number(first_present(row, ALIASES[name]))
    onset = first_present(row, ALIASES["hallucination_onset"])
    out["hallucination_onset"] = None if onset is None else int(onset)
    for name in (*SEQUENCES, "complete_reconstruction_target"):
        given = first_present(row, ALIASES[name])
        out[name] = None if given is None else np.asarray(given, float).ravel().tolist()
    for name in TENSORS:
        out[name] = None if inline(row, name) is None else json.dumps(row[name])
        out[f"{name}_path"] = None if inline(row, name) is not None else row.get(f"{name}_path")
    if out["hidden_states"] is None and out["hidden_states_path"] is None:
        raise KeyError(f"line {line_no}: needs hidden_states or hidden_states_path")
    return out


_PARSED = "row_index long, line_no long, raw string, id string, query_id string, semantic_key string, style_key string, correctness double, path_hallucinated double, hallucination_onset int, " + "".join(f"{n} array<double>, " for n in (*SEQUENCES, "complete_reconstruction_target")) + ", ".join(f"{n} string, {n}_path string" for n in TENSORS)


def _arrow_type(ddl: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[ddl]


def _parse_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split(" ") for f in _PARSED.split(", ")]
    for batch in batches:
        rows = [parse(v, n, i) for n, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], _arrow_type(ddl)) for name, ddl in fields], names=[name for name, _ in fields])


def decode_tensor(content: bytes, path: str) -> np.ndarray:
    """Array in a .npy, .json, .pt or .pth file; the last two need torch."""
    suffix = posixpath.splitext(path)[1]
    if suffix == ".npy":
        return np.load(io.BytesIO(content), allow_pickle=False)
    if suffix == ".json":
        return np.asarray(json.loads(content), float)
    if suffix in (".pt", ".pth"):
        try:
            import torch
        except ImportError as e:
            raise ImportError(f"{path}: reading {suffix} files needs torch; convert them to .npy") from e
        value = torch.load(io.BytesIO(content), map_location="cpu", weights_only=True)
        if isinstance(value, dict):
            value = next((value[k] for k in WRAPPERS if k in value), None)
        return np.asarray(value, float)
    raise ValueError(f"{path}: unknown tensor file type {suffix!r}")


def _decode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        arrays = [json.dumps(decode_tensor(c, p).tolist()) for p, c in zip(paths, batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.string())], names=["path", "tensor"])


def tensors(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path and tensor (JSON text) of all tensor files below the folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{npy,json,pt,pth}").load(folders)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").mapInArrow(_decode_files, "path string, tensor string")


def read_trajectories(spark: SparkSession, path: str, feature_root: str | None = None) -> DataFrame:
    """Trajectories of a JSON-lines file, in the columns of schema.TRAJECTORIES.

    Relative tensor paths are taken from feature_root, by default the file's
    folder. An empty file, a line that is not an object, a row without hidden
    states and tensors of the wrong rank are errors; explicit nulls shadow later
    names. Columns that are not known stay in raw.
    """
    parsed = read_lines(spark, path).mapInArrow(_parse_lines, _PARSED)
    if not parsed.limit(1).count():
        raise ValueError(f"{path}: no trajectories")
    root = feature_root or posixpath.dirname(path.rstrip("/"))
    paths = [f"{n}_path" for n in TENSORS]
    resolve = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(c)))
    rows = parsed.withColumns({c: resolve(c) for c in paths})
    suffix = F.regexp_extract(F.col("value"), r"(\.[^./]*)$", 1)
    named = rows.select(F.explode(F.array(*paths)).alias("value")).where("value is not null")
    wrong = named.where(~suffix.isin(".npy", ".json", ".pt", ".pth")).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['value']}: unknown tensor file type")
    folders = [r[0] for r in named.select(F.regexp_extract("value", "^(.*)/", 1)).distinct().collect()]
    if folders:
        files = tensors(spark, folders)
        for n in TENSORS:
            file = files.select(F.col("path").alias(f"{n}_path"), F.col("tensor").alias(f"{n}_file"))
            rows = rows.join(file, f"{n}_path", "left")
            missing = F.concat(F.lit("no tensor file "), F.col(f"{n}_path"))
            rows = rows.withColumn(n, F.coalesce(n, f"{n}_file", F.when(F.col(f"{n}_path").isNotNull(), F.raise_error(missing)))).drop(f"{n}_file")
    return rows.drop(*paths).mapInArrow(_typed, TRAJECTORIES)


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tensors as nested arrays of checked rank, labels fitted to the length."""
    matrix, vector = pa.list_(pa.list_(pa.float32())), pa.list_(pa.float32())
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            where = f"line {r['line_no']}"
            for name, rank in (("hidden_states", 2), ("condition_states", 2), ("condition_embedding", 1)):
                if r[name] is not None:
                    array = np.asarray(json.loads(r[name]), np.float32)
                    if array.ndim != rank:
                        raise ValueError(f"{where}: {name} must have rank {rank}, not {array.ndim}")
                    r[name] = array.tolist()
            if not r["hidden_states"]:
                raise ValueError(f"{where}: hidden_states has no tokens")
            for name in SEQUENCES:
                r[name] = fitted(r[name], len(r["hidden_states"]))
            dim, target = len(r["hidden_states"][0]), r["complete_reconstruction_target"]
            if target is not None and len(target) != dim:
                raise ValueError(f"{where}: complete_reconstruction_target must have {dim} values")
        columns = {
            **{n: pa.int64() for n in ("row_index",)},
            **{n: pa.string() for n in ("id", "query_id", "semantic_key", "style_key")},
            "hidden_states": matrix,
            "condition_states": matrix,
            "condition_embedding": vector,
            "correctness": pa.float64(),
            "path_hallucinated": pa.float64(),
            "hallucination_onset": pa.int32(),
            **{n: vector for n in (*SEQUENCES, "complete_reconstruction_target")},
            "raw": pa.string(),
        }
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in columns.items()], names=list(columns))


def tokens(trajectories: DataFrame) -> DataFrame:
    """One row a token: row_index, pos, n_tokens, h and the token's labels."""
    label = {"adv": "token_advantage", "prog": "progress_targets", "key_t": "key_prior_target", "comp_t": "complete_prior_target"}
    seen = trajectories.select("row_index", F.size("hidden_states").alias("n_tokens"), *label.values(), F.posexplode("hidden_states").alias("pos", "h"))
    return seen.select("row_index", "pos", "n_tokens", "h", *[F.get(F.col(c), F.col("pos")).cast("double").alias(k) for k, c in label.items()])


def condition_tokens(trajectories: DataFrame) -> DataFrame:
    """One row a condition token: row_index, cpos, c; the embedding comes last."""
    parts = F.concat(F.coalesce("condition_states", F.array().cast("array<array<float>>")), F.when(F.col("condition_embedding").isNotNull(), F.array("condition_embedding")).otherwise(F.array().cast("array<array<float>>")))
    return trajectories.select("row_index", F.posexplode(parts).alias("cpos", "c"))


def toy_trajectories(spark: SparkSession, hidden_dim: int = 8, seed: int = 0) -> DataFrame:
    """Six toy rows: three queries in two styles; the second style goes wrong at token 3."""
    base = spark.range(3).withColumnRenamed("id", "q").crossJoin(spark.range(2).withColumnRenamed("id", "k"))
    length = (F.lit(5) + F.col("k")).cast("int")
    noise = lambda n, s: F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.lit(hidden_dim)), lambda j: (F.sqrt(-2 * F.ln((F.pmod(F.xxhash64(F.lit(seed + s), F.col("q"), F.col("k"), i, j), F.lit(999_983)) + 1) / 999_984.0)) * F.cos(6.283185307179586 * F.pmod(F.xxhash64(F.lit(seed + s + 1), F.col("q"), F.col("k"), i, j), F.lit(999_983)) / 999_983.0)).cast("float")))
    at = F.sequence(F.lit(0), length - 1)
    bad = F.col("k") == 1
    advantage = F.transform(at, lambda i: F.when(bad & (i >= 3), -0.5).otherwise(0.2 * (i + 1)).cast("float"))
    return base.select(
        (F.col("q") * 2 + F.col("k")).alias("row_index"),
        F.concat(F.lit("toy-"), "q", F.lit("-"), "k").alias("id"),
        F.concat(F.lit("toy-"), "q").alias("query_id"),
        F.concat(F.lit("'toy-"), "q", F.lit("'")).alias("semantic_key"),
        F.when(bad, "'verbose'").otherwise("'direct'").alias("style_key"),
        noise(length, 0).alias("hidden_states"),
        noise(F.lit(3), 10).alias("condition_states"),
        F.lit(None).cast("array<float>").alias("condition_embedding"),
        (1 - F.col("k")).cast("double").alias("correctness"),
        F.col("k").cast("double").alias("path_hallucinated"),
        F.when(bad, 3).otherwise(-1).alias("hallucination_onset"),
        advantage.alias("token_advantage"),
        advantage.alias("progress_targets"),
        F.transform(at, lambda i: (i == 1).cast("float")).alias("key_prior_target"),
        F.transform(at, lambda i: (i < 4).cast("float")).alias("complete_prior_target"),
        F.lit(None).cast("array<float>").alias("complete_reconstruction_target"),
        F.lit(None).cast("string").alias("raw"),
    )
