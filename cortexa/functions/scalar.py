"""Scalar expressions: missing values, transforms, grids, geometry and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN counts as missing everywhere in this library, so it becomes null on the way in."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def to_z(r: Column, kind: str = "atanh") -> Column:
    """Variance-stabilising transform of a correlation: ``atanh`` (Fisher) or ``atan``."""
    return {"atanh": F.atanh, "atan": F.atan}[kind](r)


def from_z(z: Column, kind: str = "atanh") -> Column:
    return {"atanh": F.tanh, "atan": F.tan}[kind](z)


def snap(t: Column, tr: float) -> Column:
    """The nearest multiple of ``tr``; halves go up."""
    return F.floor((t + tr / 2) / tr) * tr


def nearest_frame(onset: Column, tr: float, n_frames: Column | int) -> Column:
    """Frame whose start is nearest (halves to even), at most the last."""
    last = (F.lit(n_frames) if isinstance(n_frames, int) else n_frames) - 1
    return F.least(F.bround(onset / tr).cast("long"), last.cast("long"))


def norm(*xs: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (x * x for x in xs)))


def distance(a: list[Column], b: list[Column]) -> Column:
    return norm(*(x - y for x, y in zip(a, b, strict=True)))


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Half the length of the cross product of two sides."""
    u, v = [x - y for x, y in zip(b, a, strict=True)], [x - y for x, y in zip(c, a, strict=True)]
    return norm(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]) / 2


def remap(x: Column, table: dict, default: Column | None = None) -> Column:
    """Value of ``x`` in a small fixed table."""
    found = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[x] if table else F.lit(None)
    return found if default is None else F.coalesce(found, default)


def network_name(label: Column, names: dict[int, str]) -> Column:
    return remap(label, names, F.concat(F.lit("Net-"), label.cast("string")))


def subject_name(subject: Column, width: int = 2) -> Column:
    text = subject.cast("string")
    return F.concat(F.lit("sub-"), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def trial_name(trial: Column, part: str) -> Column:
    return F.format_string(f"trial_%03d_{part}", trial)


def hemisphere(node: Column, n_nodes: int) -> Column:
    return F.when(node < n_nodes // 2, "L").otherwise("R")


def affine(ijk: list[Column], matrix: list[list[float]]) -> list[Column]:
    """Voxel indices in millimetres, by a 3 x 4 (or 4 x 4) matrix."""
    return [reduce(lambda a, b: a + b, (m * x for m, x in zip(row[:3], ijk, strict=True))) + row[3] for row in matrix[:3]]
