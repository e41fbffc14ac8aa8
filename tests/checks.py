"""What the tests compare with."""

import math

DATA = "/root/testdata/sf0.001"


def plain(value):
    """A value that compares equal however the engine types it."""
    if value is None or type(value).__name__ == "NAType":
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(round(value, 6)) + 0.0
    if isinstance(value, bool):
        return value
    return float(value) if isinstance(value, int) else value


def same_rows(df, sql, con):
    """Rows of a Spark query and of DuckDB SQL are the same, in any order, under the same names."""
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda frame: sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
    assert rows(got) == rows(want)
