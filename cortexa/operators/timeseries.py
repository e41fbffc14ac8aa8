"""Confounds, scrubbing, nuisance regression, filtering, events and design matrices."""

from __future__ import annotations

from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stored

#: The base columns of the confound table.
MOTION = ("trans_x", "trans_y", "trans_z", "rot_x", "rot_y", "rot_z")
PHYSIOLOGY = ("csf", "white_matter")
GLOBAL = "global_signal"
EXPANSIONS = ("", "_derivative1", "_power2", "_derivative1_power2")


def confound_columns(global_signal: bool = True) -> list[str]:
    """36 names (or 32 without the global signal): each base column and its three expansions."""
    base = [*MOTION, *PHYSIOLOGY, *([GLOBAL] if global_signal else [])]
    return [f"{c}{e}" for c in base for e in EXPANSIONS]


def expanded_confounds(df: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Each base column with its change from the frame before (null in the first), its square and the change's square: the columns of ``confound_columns``."""
    change = {f"{c}_derivative1": F.col(c) - F.lag(c).over(Window.partitionBy(*keys).orderBy(t)) for c in columns}
    df = df.withColumns(change)
    return df.withColumns({f"{c}_power2": F.col(c) * F.col(c) for c in [*columns, *change]})


def friston(df: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Each motion column with its lag (0 at first), its square and the lag's square."""
    w = Window.partitionBy(*keys).orderBy(t)
    lag = {f"{c}_lag": F.lag(c, 1, 0.0).over(w) for c in columns}
    df = df.withColumns(lag)
    return df.withColumns({f"{c}_power2": F.col(c) * F.col(c) for c in [*columns, *lag]})


def keep_frame(fd: Column, limit: float, inclusive: bool = False, missing_as_zero: bool = False) -> Column:
    """Frames to keep by framewise displacement; a missing value is 0 or drops the frame."""
    fd = F.when(~F.isnan(fd), fd)
    value = F.coalesce(fd, F.lit(0.0)) if missing_as_zero else fd
    return F.coalesce(value <= limit if inclusive else value < limit, F.lit(False))


def _least_squares(design: np.ndarray, keep: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Residuals on all frames of a fit to the kept ones; series has a row for each node."""
    beta, *_ = np.linalg.lstsq(design[keep], series[:, keep].T, rcond=None)
    return series - (design @ beta).T


def butterworth(low: float, high: float, tr: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a second-order Butterworth band-pass, by the bilinear transform."""
    fs = 2.0
    edges = np.array([low, high]) * 2 * tr  # as shares of the Nyquist frequency
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    poles = np.exp(1j * np.pi * (np.array([1, 3]) / 4 + 0.5)) * width / 2
    poles = np.concatenate([poles + np.sqrt(poles**2 - centre**2), poles - np.sqrt(poles**2 - centre**2)])
    gain = width**2
    digital = (2 * fs + poles) / (2 * fs - poles)
    gain *= np.real((2 * fs) ** 2 / np.prod(2 * fs - poles))
    b = gain * np.poly([1, 1, -1, -1])
    return np.real(b), np.real(np.poly(digital))


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed over the last axis, all rows at once."""
    out, z = np.empty_like(x), state.copy()
    for t in range(x.shape[1]):
        y = b[0] * x[:, t] + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * x[:, t] + z[k + 1] - a[k + 1] * y
        z[-1] = b[-1] * x[:, t] - a[-1] * y
        out[:, t] = y
    return out


def zero_phase(x: np.ndarray, low: float, high: float, tr: float) -> np.ndarray:
    """Band-pass forward and backward; rows are extended by their point reflection so that edges do not ring."""
    b, a = butterworth(low, high, tr)
    pad = min(3 * len(a), x.shape[1] - 1)
    if pad < 1:
        return x
    companion = np.eye(len(a) - 1) - np.vstack([-a[1:], np.eye(len(a) - 2, len(a) - 1)]).T
    steady = np.linalg.solve(companion, b[1:] - a[1:] * b[0])[:, None]
    wide = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    for _ in range(2):
        wide = _filtered(b, a, wide, steady * wide[:, 0])[:, ::-1]
    return wide[:, pad : pad + x.shape[1]]


def cleaned(series: DataFrame, confounds: DataFrame, keys: list[str], columns: list[str], node: str = "node", x: str = "x", t: str = "t", keep: str = "keep", detrend: bool = True, band: tuple[float, float] | None = None, tr: float = 2.0, standardise: bool = False, excise: bool = False, nodes_per_task: int = 4096) -> DataFrame:
    """keys, node, x: series without what the confounds explain, by least squares over the kept frames.

    Censored frames are interpolated before a band-pass and, with ``excise``,
    left out in the end. A run's confounds meet its nodes in blocks, so a task
    holds one run of at most about ``nodes_per_task`` series.
    """
    from_run = F.pmod(F.xxhash64(node), F.col("blocks"))
    sizes = series.groupBy(*keys).agg(F.ceil(F.count("*") / nodes_per_task).cast("int").alias("blocks"))
    left = series.join(sizes, keys).withColumn("block", from_run.cast("int"))
    right = confounds.join(sizes, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def clean(nodes: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values(t)
        kept = frames[keep].to_numpy(bool) if keep in frames else np.ones(len(frames), bool)
        if nodes.empty or not kept.any():
            return nodes.iloc[:0][[*keys, node, x]]
        values = np.stack(nodes[x].to_numpy()).astype(float)
        n = values.shape[1]
        design = [np.ones(n), *([np.linspace(-1, 1, n)] if detrend else []), *(np.nan_to_num(frames[c].to_numpy(float)) for c in columns)]
        values = _least_squares(np.stack(design, axis=1), kept, values)
        if band:
            at = np.arange(n)
            values = np.stack([np.interp(at, at[kept], v[kept]) for v in values])
            values = zero_phase(values, *band, tr)
        if excise:
            values = values[:, kept]
        if standardise:
            sd = values.std(axis=1, ddof=1, keepdims=True)
            values = (values - values.mean(axis=1, keepdims=True)) / np.where(sd < 1e-12, 1, sd)
        return nodes[[*keys, node]].assign(**{x: list(values)})

    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # apart from the same table on the left
    kinds = dict(series.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, node]), f"{x} array<double>"])
    groups = [*keys, "block"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(clean, schema)


def temporal_moments(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, their ratio (snr) and the coefficient of variation over time."""
    mean, sd = F.avg(value), F.stddev_pop(value)
    return long.groupBy(*keys).agg(mean.alias("mean"), sd.alias("sd"), F.try_divide(mean, sd).alias("snr"), F.try_divide(sd, F.abs(mean)).alias("cov"))


def noisy_nodes(moments: DataFrame, neighbours: DataFrame, node: str = "node", spread: float = 0.5) -> DataFrame:
    """node, noisy: whose coefficient of variation exceeds its neighbourhood's mean by over half its deviation.

    ``neighbours`` has (i, j, w): the weights of each node's neighbourhood,
    itself included, as a smoothing kernel gives them.
    """
    near = neighbours.join(moments.select(F.col(node).alias("j"), "cov"), "j").where("cov is not null")
    s = near.groupBy("i").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("cov")).alias("s"), F.sum(F.col("w") * F.col("cov") * F.col("cov")).alias("q"))
    mean = F.col("s") / F.col("n")
    local = s.select(F.col("i").alias(node), mean.alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("d"))
    return moments.join(local, node).select(node, (F.col("cov") > F.col("m") + spread * F.col("d")).alias("noisy"))


def event_frames(events: DataFrame, keys: list[str], kind: str, onset: str, tr: float, duration: float) -> DataFrame:
    """keys, kind, frame: frames from ceil(onset / TR) up to, without, floor(start + duration / TR + 1)."""
    start = F.ceil(F.col(onset) / tr).cast("long")
    stop = F.floor(start + duration / tr + 1).cast("long")
    return events.select(*keys, kind, F.explode(F.when(stop > start, F.sequence(start, stop - 1))).alias("frame"))


def remaining_frames(frames: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Frames in no event window."""
    return frames.join(taken.select(*keys, "frame"), [*keys, "frame"], "left_anti")


def event_series(series: DataFrame, taken: DataFrame, keys: list[str], kind: str, rest: str = "remaining") -> DataFrame:
    """Rows of a frame-wise table with the kind of event that their frame is in; other frames as ``rest``."""
    inside = series.join(taken.select(*keys, "frame", kind).distinct(), [*keys, "frame"])
    outside = remaining_frames(series, taken, keys).withColumn(kind, F.lit(rest))
    return inside.unionByName(outside)


def design_matrix(events: DataFrame, keys: list[str], kind: str, onset: str, tr: float, n_frames: int, kinds: list[str]) -> DataFrame:
    """A row for each frame and a column for each kind of event: 1 in the frame nearest to an onset."""
    hits = events.select(*keys, kind, F.least(F.bround(F.col(onset) / tr).cast("long"), F.lit(n_frames - 1)).alias("frame"))
    marks = hits.groupBy(*keys, "frame").pivot(kind, kinds).agg(F.lit(1))
    grid = events.select(*keys).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long"))))
    return grid.join(marks, [*keys, "frame"], "left").fillna(0, kinds)


def normalised_design(design: DataFrame, keys: list[str], columns: list[str], limit: float = 0.0) -> DataFrame:
    """Columns divided by their largest value of a run, then 1 above ``limit`` and 0 elsewhere."""
    top = design.groupBy(*keys).agg(*(F.max(c).alias(f"__{c}") for c in columns))
    share = {c: F.when(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"__{c}")), F.lit(0.0)) > limit, 1).otherwise(0) for c in columns}
    return design.join(top, keys).withColumns(share).drop(*(f"__{c}" for c in columns))


def snapped_onsets(events: DataFrame, onset: str, tr: float) -> DataFrame:
    """``onset_snapped``: the onset on the grid of repetition times."""
    return events.withColumn("onset_snapped", F.floor((F.col(onset) + tr / 2) / tr) * tr)


def shaped_events(events: DataFrame, scheme: str, trial: str = "trial_nr", kind: str = "trial_type", n1: str = "n1", n2: str = "n2") -> DataFrame:
    """Stimulus events with one of three labels: ``numerosity``, ``stimulus`` (which of the two) or ``trial`` (each its own)."""
    rows = events.where(F.col(trial) != 0).where(F.col(kind).isin("stim1", "stim2"))
    first = F.col(kind) == "stim1"
    label = {
        "numerosity": F.when(first, F.concat(F.lit("n1_"), F.col(n1).cast("string"))).otherwise(F.concat(F.lit("n2_"), F.col(n2).cast("string"))),
        "stimulus": F.col(kind),
        "trial": F.format_string("trial_%03d_%s", F.col(trial), F.when(first, "n1").otherwise("n2")),
    }[scheme]
    return rows.withColumn("condition", label)


def response_kernel(tr: float, length: float = 32.0) -> list[float]:
    """A double-gamma haemodynamic response sampled each TR, of sum 1: peak near 5 s, undershoot near 15 s at a sixth."""
    from math import gamma

    t = np.arange(0, length, tr)
    h = t**5 * np.exp(-t) / gamma(6) - t**15 * np.exp(-t) / gamma(16) / 6
    return (h / h.sum()).tolist()


#: Seconds that a response lasts, and the steps by which its derivatives in time and in width are taken.
RESPONSE_LENGTH, TIME_STEP, WIDTH_STEP = 32.0, 0.1, 0.01


def response(t: Column, width: float = 1.0) -> Column:
    """The double-gamma response ``t`` seconds after an impulse, 0 before it and after its length; its first gamma wider by ``width``."""
    shape = 6 / width
    first = F.exp((shape - 1) * F.log(t / width) - t / width - lgamma(shape)) / width
    second = F.exp(15 * F.log(t) - t - lgamma(16.0))
    return F.when((t > 0) & (t <= RESPONSE_LENGTH), first - second / 6).otherwise(0.0)


def responses(t: Column) -> dict[str, Column]:
    """The response, its derivative in time (an earlier response minus a later one), and that in width."""
    return {
        "response": response(t),
        "derivative": (response(t) - response(t - TIME_STEP)) / TIME_STEP,
        "dispersion": (response(t) - response(t, 1 + WIDTH_STEP)) / WIDTH_STEP,
    }


def centred_modulation(events: DataFrame, keys: list[str], kind: str, modulation: str) -> DataFrame:
    """The modulation minus its mean over the events of a kind in a run; a missing one counts as the mean."""
    means = events.groupBy(*keys, kind).agg(F.avg(modulation).alias("__mean"))
    value = F.coalesce(F.col(modulation) - F.col("__mean"), F.lit(0.0))
    return events.join(means, [*keys, kind]).withColumn(modulation, value).drop("__mean")


#: Events whose frames are listed and summed in one task; a run of one kind is never split.
DEALT = 40_000


def response_columns(events: DataFrame, keys: list[str], kind: str, onset: str, tr: float, n_frames: int, duration: str | None = None, modulation: str | None = None, oversampling: int = 10, frame_at: float = 0.5) -> DataFrame:
    """keys, kind, frame, response, derivative, dispersion (and each with ``_mod``): what events of a kind evoke in each frame that any reaches.

    Events lie on a grid of ``oversampling`` steps a frame: at the nearest step,
    or with a duration (seconds) at all steps from there until its end, each
    weighing its part of a second; an event without one is an impulse. A frame is
    measured ``frame_at`` of its length after its start, and the responses are
    evaluated at the true lag from each step and summed. With ``modulation``
    each event weighs, besides, its modulation centred over the run's events of
    its kind. Events without an onset are left out; frames before 0 and from
    ``n_frames`` on as well.
    """
    step = tr / oversampling
    rows = events.where(F.col(onset).isNotNull())
    if modulation:
        rows = centred_modulation(rows, keys, kind, modulation)
    first = F.round(F.col(onset) / step).cast("long")
    if duration is None:
        steps, weight = F.lit(1), F.lit(1.0)
    else:
        steps = F.greatest(F.lit(1), F.round(F.coalesce(F.col(duration), F.lit(0.0)) / step).cast("int"))
        weight = F.when(F.coalesce(F.col(duration), F.lit(0.0)) > 0, F.lit(step)).otherwise(1.0)
    # What begins at one step and lasts as long is one event of their summed weight, so that no key has more of them than there are steps.
    sums = [F.sum(weight).alias("__w"), *([F.sum(weight * F.col(modulation)).alias("__m")] if modulation else [])]
    rows = stored(rows.withColumn("__first", first).withColumn("__steps", steps).groupBy(*keys, kind, "__first", "__steps").agg(*sums))
    # Dealt by run and kind before the frames are listed, so that these are summed where they are.
    rows = rows.repartition(max(1, -(-rows.count() // DEALT)), *keys, kind)
    rows = rows.withColumn("__at", F.explode(F.sequence("__first", F.col("__first") + F.col("__steps") - 1))).withColumn("__at", F.col("__at") * F.lit(step))
    low = F.greatest(F.lit(0), F.ceil(F.col("__at") / tr - frame_at)).cast("long")
    high = F.least(F.lit(n_frames - 1), F.floor((F.col("__at") + RESPONSE_LENGTH + TIME_STEP) / tr - frame_at)).cast("long")
    rows = rows.withColumn("frame", F.explode(F.when(low <= high, F.sequence(low, high))))
    lag = (F.col("frame") + frame_at) * tr - F.col("__at")
    found = responses(lag)
    made = {name: column * F.col("__w") for name, column in found.items()}
    if modulation:
        made |= {f"{name}_mod": column * F.col("__m") for name, column in found.items()}
    return rows.groupBy(*keys, kind, "frame").agg(*(F.sum(column).alias(name) for name, column in made.items()))


def orthogonalised(columns: DataFrame, keys: list[str], column: str, to: str) -> DataFrame:
    """``column`` without what ``to`` explains of it within keys, over the frames that are listed (others are 0 in both)."""
    of = Window.partitionBy(*keys)  # frames of one run and kind, which are few
    fit = F.try_divide(F.sum(F.col(column) * F.col(to)).over(of), F.sum(F.col(to) * F.col(to)).over(of))
    return columns.withColumn("__b", fit).withColumn(column, F.col(column) - F.coalesce("__b", F.lit(0.0)) * F.col(to)).drop("__b")


def filled_design(columns: DataFrame, keys: list[str], kind: str, kinds: list[str], names: list[str], n_frames: int, scale: bool = False) -> DataFrame:
    """A row for each frame of each run, and a column ``<kind>_<name>`` for each kind and response, 0 where nothing is listed; with ``scale`` each divided by its largest value of the run."""
    cells = columns.groupBy(*keys, "frame").pivot(kind, kinds).agg(*(F.first(n).alias(n) for n in names))
    if len(names) == 1:
        cells = cells.select(*keys, "frame", *(F.col(k).alias(f"{k}_{names[0]}") for k in kinds))
    wide = [f"{k}_{n}" for k in kinds for n in names]
    grid = columns.select(*keys).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long"))))
    out = grid.join(cells, [*keys, "frame"], "left").fillna(0.0, wide)
    if not scale:
        return out
    top = out.groupBy(*keys).agg(*(F.max(c).alias(f"__{c}") for c in wide))
    return out.join(top, keys).select(*keys, "frame", *(F.coalesce(F.try_divide(F.col(c), F.col(f"__{c}")), F.lit(0.0)).alias(c) for c in wide))


def convolved(design: DataFrame, keys: list[str], columns: list[str], kernel: list[float]) -> DataFrame:
    """Columns of a design matrix convolved with a kernel, in frame order."""
    w = Window.partitionBy(*keys).orderBy("frame")
    value = lambda c: reduce(lambda a, b: a + b, (F.lag(F.col(c).cast("double"), k, 0.0).over(w) * float(h) for k, h in enumerate(kernel)))
    return design.withColumns({c: value(c) for c in columns})


def stacked(frames: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``x``: each key's values in order, as one array."""
    return frames.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias("x"))
