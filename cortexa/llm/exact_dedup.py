"""Exact deduplication by skew-safe combining, in DataFrame operations alone.

Texts are normalised (each run of blanks becomes one space) and digested. Copies
are combined in three steps, each grouping by digest *and* full content: the
partial aggregate inside a map task, the merge of a digest's salted groups, and
the combination of the salts' winners. A group that holds a third of all rows
thus reaches no task with more than a row per map task or per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, doc_text, partitions

SALTS = 16


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "norm"):
    return F.unhex(F.sha2(F.col(text), 256))


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per digest: ``sha`` and its ``classes``, an array of (keep_id, group_size, norm).

    A digest has one class, and its norm is null, unless different contents
    share the digest; then norm tells them apart.
    """
    rows = doc_text(docs).select("doc_id", normalised().alias("norm"))
    rows = rows.select("doc_id", "norm", digest().alias("sha"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    salted = rows.groupBy("sha", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    # Partitioned by digest alone, so that contents of one digest can meet without another shuffle.
    met = salted.repartition(partitions(docs.sparkSession), "sha")
    classes = met.groupBy("sha", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    several = classes.groupBy("sha").agg(F.count("*").alias("contents"), F.collect_list(F.struct("keep_id", "group_size", "norm")).alias("classes"))
    single = F.transform("classes", lambda c: F.struct(c["keep_id"].alias("keep_id"), c["group_size"].alias("group_size"), F.lit(None).cast("string").alias("norm")))
    return several.select("sha", F.when(F.col("contents") == 1, single).otherwise(F.col("classes")).alias("classes"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Null texts count as empty, and empty texts equal one another. Of equal texts
    the row with the smallest doc_id stays; a null doc_id stays only if its
    group has no other id, and rows that share the smallest id all stay. An
    empty table gives an empty result; columns besides doc_id and text are
    ignored.
    """
    found = checkpoint(winners(docs, salts))
    rows = doc_text(docs).select("doc_id", normalised().alias("norm"))
    rows = rows.select("doc_id", "norm", digest().alias("sha"))
    one = found.where(F.size("classes") == 1).select("sha", F.inline("classes")).drop("norm")
    joined = rows.drop("norm").join(one, "sha")
    several = found.where(F.size("classes") > 1)
    if not several.isEmpty():  # contents that share a digest: decided by the content itself
        joined = joined.unionByName(rows.join(several.select("sha", F.inline("classes")), ["sha", "norm"]).drop("norm"))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
