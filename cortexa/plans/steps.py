"""Steps of an analysis whose outputs are tables, or the partitions of one: done ones are skipped, failures stop only what depends on them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import present, stored


class Step(NamedTuple):
    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    """The output of a step that ended well, which Spark's writers mark."""
    return spark.read.parquet(path) if present(spark, f"{path}/_SUCCESS") else None


def run_steps(spark: SparkSession, folder: str, steps: list[Step], again: bool = False) -> DataFrame:
    """Run the steps in the order given; step, status (skipped, done, failed, blocked), rows, error of each."""
    made: dict[str, DataFrame] = {}
    report = []
    for step in steps:
        path = f"{folder}/{step.name}"
        if not again and (found := _done(spark, path)) is not None:
            made[step.name] = found
            report.append((step.name, "skipped", found.count(), None))
        elif any(n not in made for n in step.needs):
            report.append((step.name, "blocked", None, None))
        else:
            try:
                step.make(spark, {n: made[n] for n in step.needs}).write.mode("overwrite").parquet(path)
            except Exception as e:  # told in the report; independent steps go on
                report.append((step.name, "failed", None, str(e).splitlines()[0][:200]))
                continue
            made[step.name] = spark.read.parquet(path)
            report.append((step.name, "done", made[step.name].count(), None))
    return spark.createDataFrame(report, "step string, status string, rows long, error string")


ERROR = "__error"


def by_subject(rows: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``function`` makes of each subject's rows (its schema has the key), and the error, for one that fails, in a row of its own."""

    def guarded(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return function(group).assign(**{ERROR: None})
        except Exception as e:  # told in the report; other subjects go on
            return pd.DataFrame({key: group[key].iloc[:1], ERROR: [f"{type(e).__name__}: {e}".splitlines()[0][:200]]}).reindex(columns=[*names, ERROR])

    names = spark_names(rows.sparkSession, schema)
    return rows.groupBy(key).applyInPandas(guarded, f"{schema}, {ERROR} string")


def spark_names(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def run_subjects(spark: SparkSession, path: str, key: str, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Make the partitions of a table, one a subject, that are missing; key, status (skipped, done, failed), error.

    ``wanted`` has the subjects' keys. ``make`` gets those that have no mark yet
    and returns their rows, as ``by_subject`` does. Good rows replace the
    partitions of their subjects and no others; marks are added behind them, so a
    run that ends in between does these subjects again. A subject without any row
    is done, too.
    """
    marks = f"{path}.marks"
    wanted = wanted.select(key).distinct()
    done = spark.read.parquet(marks).select(key).distinct() if present(spark, f"{marks}/_SUCCESS") else wanted.where("false")
    missing = stored(wanted.join(done, key, "left_anti"))
    made = stored(make(missing))
    failed = stored(made.where(F.col(ERROR).isNotNull()).groupBy(key).agg(F.min(ERROR).alias("error")))
    good = made.where(F.col(ERROR).isNull()).join(failed, key, "left_anti").drop(ERROR)
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    new = stored(missing.join(failed, key, "left_anti").select(key))
    new.write.mode("append").parquet(marks)
    skipped = wanted.join(missing, key, "left_anti").select(key, F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    report = new.select(key, F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
    return stored(skipped.union(report).union(failed.select(key, F.lit("failed").alias("status"), "error")))
