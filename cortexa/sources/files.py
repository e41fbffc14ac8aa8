"""Readers and writers of the file kinds that node data come in."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import discard, move, present


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", missing: str = "n/a") -> DataFrame:
    """A CSV or TSV file with a header and a declared schema."""
    return spark.read.csv(path, header=True, sep=sep, schema=schema, nullValue=missing, nanValue="NaN", enforceSchema=False)


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that there are."""
    return df.select(*(c for c in wanted if c in df.columns))


def read_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """path, line (from 0 in each file), value, in splits: a line's number is its place in its split, and the lines of the splits before.

    With ``parts`` the files are parts of one, in order of their names: lines are numbered through all of them.

    A first pass counts the lines of each split; both passes plan the same ones.
    """
    at = F.col("_metadata")
    rows = spark.read.text(path).select(at["file_path"].alias("path"), at["file_block_start"].alias("__split"), F.monotonically_increasing_id().alias("__id"), "value")
    splits = rows.groupBy("path", "__split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    # A row for each split; of all parts they are put in order in one task.
    order = Window.orderBy("path", "__split") if parts else Window.partitionBy("path").orderBy("__split")
    before = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("path", "__split", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__offset"))
    return rows.join(F.broadcast(offsets), ["path", "__split"]).select("path", (F.col("__id") + F.col("__offset")).alias("line"), "value")


def read_matrix(spark: SparkSession, path: str, sep: str = ",", parts: bool = False) -> DataFrame:
    """path, i, j, w of headerless numeric matrices, or of one in ``parts``."""
    rows = read_lines(spark, path, parts).where(F.trim("value") != "")
    cells = rows.select("path", F.col("line").cast("int").alias("i"), F.posexplode(F.split("value", sep)).alias("j", "w"))
    return cells.withColumn("w", F.expr("try_cast(trim(w) AS double)"))


def read_scalar(spark: SparkSession, path: str) -> DataFrame:
    """path, value: the first number of each file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("v"))
    return rows.select("path", F.col("v").cast("double").alias("value"))


def read_spaced(spark: SparkSession, path: str, skip: int, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """A table with blanks between its columns: name -> (position, type); the first ``skip`` lines are left out."""
    rows = read_lines(spark, path).where(F.col("line") >= skip).where(F.trim("value") != "").select("path", "line", F.split(F.trim("value"), r"\s+").alias("v"))
    return rows.select("path", "line", *(F.get("v", F.lit(k)).cast(kind).alias(name) for name, (k, kind) in columns.items()))


def arrays(files: DataFrame) -> DataFrame:
    """path, name, shape, values (flat, row by row) of .npy and .npz files in a table (path, content)."""

    def of(frames):
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {"": loaded} if isinstance(loaded, np.ndarray) else {k: loaded[k] for k in loaded.files}
                out += [(name, k, list(v.shape), v.astype(float).ravel()) for k, v in arrays.items() if v.dtype.kind in "biuf"]
            yield pd.DataFrame(out, columns=["path", "name", "shape", "values"])

    return files.select("path", "content").mapInPandas(of, "path string, name string, shape array<int>, values array<double>")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The arrays of .npy and .npz files below a path."""
    return arrays(spark.read.format("binaryFile").load(path))


def matrix_rows(arrays: DataFrame) -> DataFrame:
    """path, name, node, x: the rows of two-dimensional arrays."""
    width = F.col("shape")[1]
    rows = arrays.where("size(shape) = 2").withColumn("node", F.explode(F.sequence(F.lit(0), F.col("shape")[0] - 1)))
    return rows.select("path", "name", "node", F.slice("values", F.col("node") * width + 1, width).alias("x"))


def array_bytes(df: DataFrame, x: str = "x") -> DataFrame:
    """``npy``: each row's array in the .npy format, for a sink of binary files."""

    def of(frames):
        for frame in frames:
            out = []
            for values in frame[x]:
                np.save(buffer := io.BytesIO(), np.asarray(values, float))
                out.append(buffer.getvalue())
            yield frame.assign(npy=out)

    return df.mapInPandas(of, StructType([*df.schema.fields, StructField("npy", BinaryType())]))


def write_edges(edges: DataFrame, path: str, density: str = "density") -> None:
    """A thresholded graph for each density, as a partitioned table."""
    edges.write.mode("overwrite").partitionBy(density).parquet(path)


def read_sidecars(spark: SparkSession, path: str, schema: str = "RepetitionTime DOUBLE, TaskName STRING") -> DataFrame:
    """path and the declared keys of JSON sidecar files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("s")).select("path", "s.*")


def with_key(df: DataFrame, column: str, key: str, value: Column) -> DataFrame:
    """JSON objects with one key set, other keys as they are."""
    parsed = F.from_json(column, "map<string,string>")
    return df.withColumn(column, F.to_json(F.map_concat(F.map_filter(parsed, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path of every file below a folder whose name matches, without reading any."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")


def inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """subject, session, task, run and file name, parsed from paths; rows without a subject are left out."""
    part = lambda key, value: F.when(F.col(path).rlike(rf"{key}-{value}"), F.regexp_extract(path, rf"{key}-({value})", 1))
    out = paths.select(
        part("sub", "[0-9A-Za-z]+").alias("subject"),
        part("ses", "[0-9A-Za-z]+").alias("session"),
        part("task", "[0-9A-Za-z]+").alias("task"),
        part("run", "[0-9]+").cast("int").alias("run"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("filename"),
    )
    return out.where("subject is not null")


def chosen_file(paths: DataFrame, keys: list[str], path: str = "filename", last: bool = False) -> DataFrame:
    """One file of each key: the first in order of name, or the last."""
    return paths.groupBy(*keys).agg((F.max if last else F.min)(path).alias(path))


def missing_outputs(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, replaced or joined by new ones of the same key; of several new rows the last in order of all columns."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = sorted(c for c in both.columns if c not in {*keys, "__new"})
    order = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), *(F.col(c).desc_nulls_last() for c in rest))
    return both.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "__new")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Upsert into a Parquet table that this reads, too.

    The merged rows are complete in a folder beside the table, ``<path>.new``,
    before the table is replaced by it. A run that ends in between leaves that
    folder, from which the next one goes on.
    """
    beside = f"{path}.new"
    if present(spark, f"{beside}/_SUCCESS"):
        discard(spark, path)
        move(spark, beside, path)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first rows make the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.parquet(path)
        return
    upserted(old, new, keys).write.mode("overwrite").parquet(beside)
    discard(spark, path)
    move(spark, beside, path)


def append(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def rename_plan(paths: DataFrame, rules: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """path, target, changed, clashes: what renaming by a chain of patterns would do; nothing is moved."""
    target = F.col(path)
    for pattern, replacement in rules:
        target = F.regexp_replace(target, pattern, replacement)
    plan = paths.select(F.col(path).alias("path"), target.alias("target"))
    counts = plan.groupBy("target").agg(F.count("*").alias("n"))
    return plan.join(counts, "target").select("path", "target", (F.col("path") != F.col("target")).alias("changed"), (F.col("n") > 1).alias("clashes"))
