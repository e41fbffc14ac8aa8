"""The driver's tables in the roles that the operators ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without a negative zero."""
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x, label: a series for each vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("x"), "label")


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, label, hemi, g1, g2, g3: the first three entries of each vector."""
    g = [F.col("embedding")[k].cast("double").alias(f"g{k + 1}") for k in range(3)]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "label", F.pmod("vec_id", F.lit(2)).cast("int").alias("hemi"), *g)


def module() -> Column:
    """A community of a node, by its first gradient: -1 (none) for strongly negative ones."""
    return F.when(F.col("g1") < -0.2, -1).otherwise(F.floor((F.col("g1") + 0.2) * 10).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, event_id, day, onset (seconds of the day), label, value, k (from the JSON)."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), "event_id", F.dayofmonth("ts").alias("day"), second.cast("double").alias("onset"), F.col("event_type").alias("label"), "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, grp: each subject's group."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"))


#: SQL of the views above, for the twins of the queries.
CTE = """
ev AS (SELECT user_id AS subject, event_id, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS onset, event_type AS label, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
gr AS (SELECT c_custkey AS subject, c_mktsegment AS grp FROM customer),
gd AS (SELECT vec_id AS node, label, CAST(vec_id % 2 AS INTEGER) AS hemi, CAST(embedding[1] AS DOUBLE) AS g1, CAST(embedding[2] AS DOUBLE) AS g2, CAST(embedding[3] AS DOUBLE) AS g3 FROM embeddings),
md AS (SELECT *, CASE WHEN g1 < -0.2 THEN -1 ELSE CAST(floor((g1 + 0.2) * 10) AS INTEGER) END AS module FROM gd),
cx AS (SELECT vec_id AS node, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS x FROM embeddings),
ce AS MATERIALIZED (SELECT a.node AS i, b.node AS j, list_cosine_similarity(a.x, b.x) AS w FROM cx a JOIN cx b ON a.node < b.node),
c2 AS (SELECT i, j, w FROM ce UNION ALL SELECT j, i, w FROM ce)
"""


def p_of_t(t: str, df: str) -> str:
    """SQL of the two-sided p of Student's t, by Simpson's rule."""
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi() * {df}) * abs({t}) / 6000 * list_sum(list_transform(range(2001), lambda s: (CASE WHEN s IN (0, 2000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs({t}) * s / 2000, 2) / {df}, -({df} + 1) / 2))))"
