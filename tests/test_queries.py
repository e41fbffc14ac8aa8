"""Every registered query of the library against its SQL, or that it runs."""

import pytest
from checks import DATA, same_rows

from cortexa.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(name, spark, duck):
    same_rows(registry.QUERIES[name](spark, DATA), registry.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"diffusion_gradients", "map_communities"}))
def test_query_runs(name, spark):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_names_of_long_subject_numbers(spark, tmp_path):
    """A subject above 999 is called by three characters, as the SQL does."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (user_id * 37 AS user_id) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet'")
    for name in ("customer", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same_rows(registry.QUERIES["parsed_names"](spark, str(tmp_path)), registry.SQL["parsed_names"], con)
