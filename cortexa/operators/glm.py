"""Mass-univariate general linear models: one regression for every key, contrasts and thresholds.

One grouped pass gives each key's sums of products, packed in arrays, so keys of
any number of rows leave one row a task. The k x k systems are solved in Arrow
batches on the executors, all keys of a batch at once.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.distributions import t_two_sided
from ..sources.shared import stored
from .stats import benjamini_hochberg, bonferroni

INTERCEPT = "intercept"


def normal_equations(df: DataFrame, keys: list[str], y: str, terms: list[str]) -> DataFrame:
    """keys, xx (upper triangle, row by row), xy and yy; rows with a null or NaN are left out."""
    names = [f"__x{k}" for k in range(len(terms) + 1)]
    rows = df.select(*keys, F.lit(1.0).alias(names[0]), *(F.col(t).cast("double").alias(n) for t, n in zip(terms, names[1:], strict=True)), F.col(y).cast("double").alias("__y")).dropna(subset=[*names[1:], "__y"])
    xx = [F.sum(F.col(a) * F.col(b)) for k, a in enumerate(names) for b in names[k:]]
    xy = [F.sum(F.col(a) * F.col("__y")) for a in names]
    return rows.groupBy(*keys).agg(F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(F.col("__y") * F.col("__y")).alias("yy"))


def t_to_z(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The normal deviate with the same two-sided p, and the sign of t."""
    half = np.clip(t_two_sided(t, df) / 2, 1e-300, 0.5)
    inverse = NormalDist().inv_cdf
    return np.sign(t) * np.array([-inverse(p) for p in half.tolist()])


def solved(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, contrasts: np.ndarray) -> tuple[np.ndarray, ...]:
    """df (a row a system), and effect, se and t of every contrast; NaN where a contrast cannot be estimated or no degree of freedom is left."""
    scale = np.sqrt(np.maximum(np.einsum("nkk->nk", xx), 1e-300))
    unit = xx / scale[:, :, None] / scale[:, None, :]
    values, axes = np.linalg.eigh(unit)
    kept = values > 1e-10 * values[:, -1:]
    inverse = np.einsum("nik,nk,njk->nij", axes, np.where(kept, 1 / np.where(kept, values, 1), 0), axes) / scale[:, :, None] / scale[:, None, :]
    beta = np.einsum("nij,nj->ni", inverse, xy)
    df = xx[:, 0, 0] - kept.sum(axis=1)
    spread = np.maximum(0, yy - np.einsum("ni,ni->n", beta, xy)) / np.where(df > 0, df, np.nan)
    # A contrast can be estimated if nothing of it lies in directions that the rows do not vary in.
    scaled = contrasts[None] / scale[:, None, :]
    lost = np.einsum("nci,nik,nk->nck", scaled, axes, ~kept)
    good = np.abs(lost).max(axis=2) < 1e-6 * np.maximum(1e-300, np.abs(scaled).max(axis=2))
    effect = np.where(good, beta @ contrasts.T, np.nan)
    se = np.where(good, np.sqrt(np.einsum("ci,nij,cj->nc", contrasts, inverse, contrasts) * spread[:, None]), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, effect / se, np.nan)
    return df, effect, se, t


def mass_glm(df: DataFrame, keys: list[str], y: str, terms: list[str], contrasts: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """keys, contrast, df, effect, se, t, p, z of each contrast of the coefficients, for every key.

    A contrast weighs terms, or ``intercept``; by default there is one for the
    intercept and for each term. Where terms depend on one another within a key,
    contrasts that they leave undetermined are null, as is the rest where no
    degree of freedom is left. A key without a complete row has no rows.
    """
    names = [INTERCEPT, *terms]
    contrasts = contrasts or {n: {n: 1.0} for n in names}
    if unknown := {t for c in contrasts.values() for t in c} - set(names):
        raise ValueError(f"no such terms: {sorted(unknown)}")
    matrix, labels, k = np.array([[c.get(n, 0.0) for n in names] for c in contrasts.values()]), list(contrasts), len(names)
    upper = np.triu_indices(k)

    def of(batches):
        for batch in batches:
            n = batch.num_rows
            flat, xy, yy = (batch.column(c) for c in ("xx", "xy", "yy"))
            xx = np.zeros((n, k, k))
            xx[:, upper[0], upper[1]] = xx[:, upper[1], upper[0]] = flat.flatten().to_numpy().reshape(n, -1)
            dof, effect, se, t = solved(xx, xy.flatten().to_numpy().reshape(n, k), yy.to_numpy(), matrix)
            flat_df = np.repeat(dof, len(labels))
            known = ~np.isnan(t.ravel())
            p, z = np.full(known.shape, np.nan), np.full(known.shape, np.nan)
            if known.any():
                p[known], z[known] = t_two_sided(t.ravel()[known], flat_df[known]), t_to_z(t.ravel()[known], flat_df[known])
            row = pa.array(np.repeat(np.arange(n), len(labels)))
            numbers = [pa.array(x, from_pandas=True) for x in (flat_df, effect.ravel(), se.ravel(), t.ravel(), p, z)]
            yield pa.RecordBatch.from_arrays([*(batch.column(key).take(row) for key in keys), pa.array(labels * n), *numbers], [*keys, "contrast", "df", "effect", "se", "t", "p", "z"])

    sums = normal_equations(df, keys, y, terms)
    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"`{key}` {kinds[key]}" for key in keys), "contrast string", *(f"{c} double" for c in ("df", "effect", "se", "t", "p", "z"))])
    return sums.mapInArrow(of, schema)


def thresholded(found: DataFrame, alpha: float, control: str = "fpr", value: str = "z") -> DataFrame:
    """``<value>_kept``: the statistic where it is significant, else 0.

    ``control`` is ``fpr`` (p of each key below alpha), ``fdr`` or
    ``bonferroni`` over all keys of a contrast, however many these are.
    """
    if control == "fpr":
        rows, p = found, "p"
    else:
        correct, p = {"fdr": (benjamini_hochberg, "p_fdr"), "bonferroni": (bonferroni, "p_bonferroni")}[control]
        found = stored(found)
        labels = [r["contrast"] for r in found.select("contrast").distinct().collect()]  # one row a contrast
        rows = reduce(DataFrame.unionByName, [correct(found.where(F.col("contrast") == c)) for c in sorted(labels)]) if labels else correct(found)
    return rows.withColumn(f"{value}_kept", F.when(F.coalesce(F.col(p) < alpha, F.lit(False)), F.col(value)).otherwise(0.0)).select(*found.columns, f"{value}_kept")
