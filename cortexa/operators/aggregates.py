"""Grouped summaries: label sizes, votes, dispersion, centroids, transformed means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import distance, from_z, norm, to_z


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of the known values."""
    q = [F.percentile(value, p).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *q, F.max(value).alias("max"))


def label_sizes(df: DataFrame, keys: list[str], label: str, weight: Column | None = None, roi: DataFrame | None = None, node: str = "node") -> DataFrame:
    """``size`` of each label: rows, or the sum of a weight; only over nodes of ``roi`` if there is one."""
    rows = df if roi is None else df.join(roi.select(node), node, "left_semi")
    size = F.count("*").cast("double") if weight is None else F.sum(weight)
    return rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(size.alias("size"))


def suppress_small(df: DataFrame, keys: list[str], module: str, least: int) -> DataFrame:
    """Modules with fewer than ``least`` rows become 0."""
    sizes = df.groupBy(*keys, module).agg(F.count("*").alias("__n"))
    joined = df.join(sizes, [*keys, module])
    return joined.withColumn(module, F.when(F.col("__n") >= least, F.col(module)).otherwise(0)).drop("__n")


def plurality(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The commonest label above 0 of each key, the lowest of equals; 0 without votes."""
    votes = df.groupBy(*keys, label).agg(F.count_if(F.col(label) > 0).alias("v"))
    best = F.max(F.when(F.col("v") > 0, F.struct("v", (-F.col(label)).alias("l"))))
    return votes.groupBy(*keys).agg(F.coalesce(-best["l"], F.lit(0)).alias("winner"), F.coalesce(best["v"], F.lit(0)).alias("votes"))


def consensus(df: DataFrame, keys: list[str], label: str, threshold: str) -> DataFrame:
    """The label at the sparsest threshold at which the key is assigned (label > 0); null if never."""
    assigned = F.when(F.col(label) > 0, F.struct(F.col(threshold), F.col(label)))
    return df.groupBy(*keys).agg(F.min(assigned)[label].alias("consensus"))


def centre(column: str, kind: str) -> Column:
    return {"median": F.median, "mean": F.avg}[kind](column)


def dispersion(df: DataFrame, keys: list[str], axes: list[str], kind: str = "median", absolute: bool = False) -> DataFrame:
    """Mean squared distance (or mean distance) to the centroid, whose axes are medians or means."""
    known = df.where(" and ".join(f"{a} is not null" for a in axes))
    mid = known.groupBy(*keys).agg(*(centre(a, kind).alias(f"__{a}") for a in axes))
    d = distance([F.col(a) for a in axes], [F.col(f"__{a}") for a in axes])
    return known.join(mid, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d if absolute else d * d).alias("dispersion"))


def centroids(df: DataFrame, keys: list[str], axes: list[str], kind: str = "median") -> DataFrame:
    return df.groupBy(*keys).agg(*(centre(a, kind).alias(a) for a in axes))


def between_distances(df: DataFrame, keys: list[str], label: str, axes: list[str]) -> DataFrame:
    """label_a < label_b and the distance of their centroids, for each key."""
    a = df.select(*keys, F.col(label).alias("label_a"), *(F.col(x).alias(f"{x}_a") for x in axes))
    b = df.select(*keys, F.col(label).alias("label_b"), *(F.col(x).alias(f"{x}_b") for x in axes))
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).where("label_a < label_b")
    return pairs.select(*keys, "label_a", "label_b", distance([F.col(f"{x}_a") for x in axes], [F.col(f"{x}_b") for x in axes]).alias("distance"))


def eccentricity(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Mean distance from the origin."""
    return df.groupBy(*keys).agg(F.avg(norm(*(F.col(a) for a in axes))).alias("eccentricity"))


def transformed_mean(df: DataFrame, keys: list[str], value: str, kind: str = "atanh") -> DataFrame:
    """Mean correlation in transformed space over the rows that there are (never over those that should be)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), from_z(F.avg(to_z(F.col(value), kind)), kind).alias("mean_r"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.max(value) - F.min(value)).alias("range"))


def complete_subjects(df: DataFrame, subject: str, condition: str, needed: int) -> DataFrame:
    """Rows of subjects that have ``needed`` different conditions."""
    whole = df.groupBy(subject).agg(F.countDistinct(condition).alias("k")).where(F.col("k") == needed)
    return df.join(whole, subject, "left_semi")


def retention(df: DataFrame, keys: list[str], kept: str) -> DataFrame:
    """Frames, frames kept and their ratio to three places."""
    kept_n = F.count_if(F.col(kept))
    return df.groupBy(*keys).agg(F.count("*").alias("n_frames"), kept_n.alias("n_kept"), F.round(kept_n / F.count("*"), 3).alias("ratio"))


def assigned_share(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of rows with a label above 0, and how many labels there are."""
    on = F.col(label) > 0
    return df.groupBy(*keys).agg(F.avg(F.coalesce(on, F.lit(False)).cast("int")).alias("share"), F.countDistinct(F.when(on, F.col(label))).alias("n_labels"))


def enough_data(df: DataFrame, keys: list[str], run: str, usable: str, frames: int, runs: int, inclusive: bool = False) -> DataFrame:
    """Keys with at least ``runs`` runs of more than (or, inclusive, at least) ``frames`` usable frames."""
    n = F.count_if(F.col(usable))
    per_run = df.groupBy(*keys, run).agg(n.alias("n")).where(F.col("n") >= frames if inclusive else F.col("n") > frames)
    return per_run.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_frames")).where(F.col("n_runs") >= runs)


def drop_largest(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Rows without the one with the largest value of each key (the smallest tie-breaker of equals)."""
    top = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(tie)).alias("__t"))).alias("__top"))
    gone = top.select(*keys, (-F.col("__top.__t")).alias(tie))
    return df.join(gone, [*keys, tie], "left_anti")

