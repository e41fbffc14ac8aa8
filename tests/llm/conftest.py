import pytest

#: Columns that clash with names inside the operators.
CLASHING = "fp string, norm string, sha string, key string, salt string, n string, row string, size string, shard string, component string"


@pytest.fixture
def docs_of(spark):
    """A documents table with clashing columns from (doc_id, text) pairs, or (doc_id, text, lang)."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), *(["x"] * 10)) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
