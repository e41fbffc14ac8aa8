"""Smoothing on a voxel grid, and voxels that are noisier than their neighbourhood.

Voxels are dealt into cubes with a halo as wide as the kernel reaches, so they are
shuffled once, and each cube is smoothed by three passes along one axis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Edge of a cube in voxels, without its halo; standard deviations at which a kernel ends.
EDGE, REACH = 32, 4.0

#: The mean below which a voxel's spread is measured against this instead.
LEAST_MEAN = 1e-6


def sigma_of(fwhm_mm: float, voxel_mm: float) -> float:
    """Standard deviation in voxels of a kernel given by its full width at half maximum."""
    return fwhm_mm / 2.355 / voxel_mm


def gaussian(sigma: float, reach: float = REACH) -> np.ndarray:
    half = int(reach * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return weights / weights.sum()


def _along(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """The sums of neighbours along an axis; the ends, half a kernel wide, go."""
    n = x.shape[axis] - len(weights) + 1
    return sum(w * x.take(range(k, k + n), axis=axis) for k, w in enumerate(weights))


def smoothed(voxels: DataFrame, values: list[str], sigma: float, keys: list[str] = (), axes: tuple[str, str, str] = ("x", "y", "z"), edge: int = EDGE, reach: float = REACH) -> DataFrame:
    """keys, axes and each of ``values`` as the Gaussian mean over the voxels of the table within the kernel's reach.

    ``axes`` are whole numbers. Weights add up to 1 over the voxels that there
    are, so the edge of a mask does not fade; a null or NaN value counts as no
    voxel, and gets the mean of its neighbourhood (null if that is empty). Each
    voxel is in the table once for each key.
    """
    weights = gaussian(sigma, reach)
    half = len(weights) // 2
    rows = voxels.select(*keys, *(F.col(a).cast("long").alias(a) for a in axes), *(F.col(v).cast("double").alias(v) for v in values))
    tiles = []
    for a in axes:
        low, high = F.floor((F.col(a) - half) / F.lit(edge)), F.floor((F.col(a) + half) / F.lit(edge))
        tiles.append(f"__{a}")
        rows = rows.withColumn(f"__{a}", F.explode(F.sequence(low, high)))

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        corner = np.array([group[t].iloc[0] * edge for t in tiles])
        at = group[list(axes)].to_numpy() - corner + half
        own = ((at >= half) & (at < half + edge)).all(axis=1)
        out = group.loc[own, [*keys, *axes]].copy()
        if not own.any():
            return out.assign(**{v: np.zeros(0) for v in values})
        for v in values:
            x = group[v].to_numpy(float)
            known = ~np.isnan(x)
            sums = []
            for filled in (np.where(known, x, 0), known.astype(float)):
                cube = np.zeros((edge + 2 * half,) * 3)
                cube[tuple(at.T)] = filled
                for axis in range(3):
                    cube = _along(cube, weights, axis)
                sums.append(cube[tuple((at[own] - half).T)])
            with np.errstate(invalid="ignore", divide="ignore"):
                out[v] = np.where(sums[1] > 0, sums[0] / sums[1], np.nan)
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{a}` long" for a in axes), *(f"`{v}` double" for v in values)])
    found = rows.groupBy(*keys, *tiles).applyInPandas(smooth, schema)
    return found.select(*keys, *axes, *(F.nanvl(F.col(v), F.lit(None)).alias(v) for v in values))


def noisy_voxels(moments: DataFrame, sigma: float, keys: list[str] = (), axes: tuple[str, str, str] = ("x", "y", "z"), spread: float = 0.5, least_mean: float = LEAST_MEAN) -> DataFrame:
    """keys, axes, cov, noisy: voxels (with ``mean`` and ``sd`` over time) whose coefficient of variation exceeds its smoothed neighbourhood by over ``spread`` deviations.

    The local deviation is the root of the smoothed squares minus the square of
    the smoothed values; a mean nearer to 0 than ``least_mean`` counts as that.
    """
    cov = F.col("sd") / F.greatest(F.abs("mean"), F.lit(least_mean))
    rows = moments.select(*keys, *axes, cov.alias("cov")).withColumns({"__m": F.col("cov"), "__q": F.col("cov") * F.col("cov")})
    near = smoothed(rows, ["__m", "__q"], sigma, keys, axes)
    both = rows.select(*keys, *axes, "cov").join(near, [*keys, *axes])
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") - F.col("__m") * F.col("__m")))
    return both.select(*keys, *axes, "cov", (F.col("cov") > F.col("__m") + spread * deviation).alias("noisy"))
