"""Frame-ordered operators: lags, counters, fills, interpolation, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stored


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``__part``: rows dealt into ranges of an order, written so that the parts stay as they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def by_part(rows: DataFrame, value: Column, start: float, step, backwards: bool = False) -> DataFrame:
    """__part, __carry: what ``step`` makes of the values of the parts before (or behind), one value for each part."""
    found = sorted((tuple(r) for r in rows.groupBy("__part").agg(value.alias("v")).collect()), reverse=backwards)
    carried, carry = [], start
    for part, v in found:
        carried.append((part, float(carry)))
        carry = step(carry, v)
    return rows.sparkSession.createDataFrame(carried, "__part int, __carry double")


def sum_below(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``name``: sum of the values of rows before this one in order, within keys; without keys over ranges, so never in one task."""
    w = Window.partitionBy(*(keys or ["__part"])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(w), F.lit(0)).cast("double")
    if keys:
        return df.withColumn(name, own)
    rows = ranged(df, [order])
    carry = by_part(rows, F.sum(value), 0.0, lambda a, b: a + b)
    return rows.withColumn(name, own).join(F.broadcast(carry), "__part").withColumn(name, F.col(name) + F.col("__carry")).drop("__part", "__carry")


def trial_counter(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """``trial_nr``: trials begun so far, carried on over the runs of a subject."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("trial_nr", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def from_neighbours(df: DataFrame, keys: list[str], order: list[str], column: str, offset: int) -> DataFrame:
    """Fill a missing value from the row ``offset`` before (negative: after)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(column, F.coalesce(F.col(column), F.lag(column, offset).over(w)))


def filled(df: DataFrame, keys: list[str], order: str, columns: list[str], forward_too: bool = True) -> DataFrame:
    """Back-fill in frame order, and forward-fill what is left at the end."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    value = lambda c: F.coalesce(F.first(c, True).over(ahead), F.last(c, True).over(back)) if forward_too else F.first(c, True).over(ahead)
    return df.withColumns({c: value(c) for c in columns})


def interpolated(df: DataFrame, keys: list[str], order: str, value: str, keep: str) -> DataFrame:
    """``value_filled``: frames not kept lie on the line between their kept neighbours, or take the nearest at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    point = F.when(F.col(keep), F.struct(F.col(order).cast("double").alias("t"), F.col(value).alias("v")))
    rows = df.withColumn("__p", F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    p, n, t = F.col("__p"), F.col("__n"), F.col(order).cast("double")
    line = p["v"] + (n["v"] - p["v"]) * F.try_divide(t - p["t"], n["t"] - p["t"])
    return rows.withColumn("value_filled", F.when(F.col(keep), F.col(value)).when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(line)).drop("__p", "__n")


def top_k(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """Rows with the k largest values of each key; of equals the smaller tie-breaker first."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_matched(df: DataFrame, keys: list[str], value: str, tie: str, seed: int, mean: float = 0.5, std: float = 0.1) -> DataFrame:
    """``resampled``: the k-th smallest value becomes the k-th smallest of as many seeded normal draws.

    Draws are a function of key, tie-breaker and seed (Box-Muller on their
    hashes), so a task that runs again draws the same.
    """
    unit = lambda salt: (F.pmod(F.xxhash64(*keys, tie, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draws = df.select(*keys, (F.lit(mean) + std * F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))).alias("resampled"), F.col(tie).alias("__tie"))
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)))
    drawn = draws.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("resampled", "__tie"))).drop("__tie")
    return ranked.join(drawn, [*keys, "__k"]).drop("__k")


def intervals(df: DataFrame, keys: list[str], kind: str, onset: str, first: str, second: str) -> DataFrame:
    """``interval``: onset of one kind of event to another of each trial."""
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(onset)))
    return df.groupBy(*keys).agg((at(second) - at(first)).alias("interval"))


def disambiguated(df: DataFrame, name: str, position: str) -> DataFrame:
    """``unique_name``: the name, with _2, _3 ... from its second appearance on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(position))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat_ws("_", name, k)))


def prefix_sweep(df: DataFrame, keys: list[str], order: str, step: int, *metrics: Column) -> DataFrame:
    """Metrics over the first ``n_first`` frames, for n_first = all, all - step, all - 2 step and so on.

    A frame counts for each prefix that reaches it. Prefixes end at a common
    grid, so frames are summed by grid cell first only where a metric allows;
    here each is repeated once for each prefix.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = df.withColumn("__n", n.cast("int")).withColumn("__t", at)
    cuts = F.filter(F.sequence(F.col("__n"), F.lit(1), F.lit(-step)), lambda c: c > F.col("__t"))
    return rows.withColumn("n_first", F.explode(F.when(F.col("__n") > 0, cuts))).groupBy(*keys, "n_first").agg(*metrics)


def split_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``frame``: position in the concatenation of a subject's runs."""
    return df.withColumn("frame", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
