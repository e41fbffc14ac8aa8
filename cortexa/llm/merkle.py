"""Merkle fixity audit of WARC records.

Pages are laid out as WARC response records in files of consecutive ids. Each
record is hashed; nodes above hash up to 16 children in the order of their
offsets, each with the length of the range that it covers; file roots are hashed
on, file by file, up to one root for the archive. Two replicas are compared from their roots down, and
only children of nodes that differ are looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import checkpoint, stored

FANOUT, PER_FILE = 16, 1024

#: Files among which pages without an id are dealt, by their content.
UNNAMED_FILES = 1024


def records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """file, page_id, record: the text of each page's WARC record, header and payload."""
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    page = F.col("page_id").cast("long")
    unnamed = -1 - F.pmod(F.xxhash64(url, html), F.lit(UNNAMED_FILES))
    line = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )
    return pages.select(F.coalesce(F.floor(page / per_file), unnamed).cast("long").alias("file"), page.alias("page_id"), line.alias("record"))


def write_warc(pages: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Write the records as WARC text, a folder for each file number, in order of page_id."""
    rows = records(pages, per_file).repartition("file").sortWithinPartitions("file", "page_id")
    rows.select("file", "record").write.partitionBy("file").option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of the records of WARC text files below ``path``, found by their Content-Length."""

    def of(batches):
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                at = data.find(b"WARC/1.")
                while at >= 0:
                    end = data.index(b"\r\n\r\n", at)
                    head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
                    size = int(head[b"Content-Length"])
                    page = head[b"WARC-Record-ID"].removeprefix(b"<urn:page:").removesuffix(b">")
                    out.append((int(page) if page else None, head.get(b"WARC-Target-URI", b"").decode(), data[end + 4 : end + 4 + size].decode()))
                    at = data.find(b"WARC/1.", end + 4 + size)
            columns = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "html"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(of, "page_id long, url string, html string")


def manifest(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """file, place, page_id, start, stop, hash of every record, in order of page_id (ties by hash).

    ``place`` is the id's own slot in its file, so a record that is lost does
    not shift the places of those behind it. Null urls and pages are empty
    ones. Pages without an id go to files with negative numbers, to places by
    their content. Other columns are ignored.
    """
    rows = records(pages, per_file).select("file", "page_id", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("size"))
    order = Window.partitionBy("file").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("size").over(order)
    slot = F.coalesce(F.pmod("page_id", F.lit(per_file)), F.pmod(F.xxhash64("hash"), F.lit(per_file))).cast("long")
    return rows.select("file", slot.alias("place"), "page_id", (stop - F.col("size")).alias("start"), stop.alias("stop"), "hash")


def leaves(rows: DataFrame) -> DataFrame:
    """part, place, size, hash of every slot that has records.

    One record's hash stands for itself. Records that share an id are summed
    piece by piece, which needs no order and gathers none of them anywhere.
    """
    pieces = [F.sum(F.conv(F.substring("hash", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")) for k in range(4)]
    met = rows.groupBy(F.col("file").alias("part"), "place").agg(F.sum(F.col("stop") - F.col("start")).alias("size"), F.count("*").alias("n"), F.max("hash").alias("one"), F.concat_ws(":", *(x.cast("string") for x in pieces)).alias("sums"))
    return met.select("part", "place", "size", F.when(F.col("n") == 1, F.col("one")).otherwise(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "sums"), 256)).alias("hash"))


class Level(NamedTuple):
    nodes: DataFrame  # part, place, size, hash
    parent: tuple  # columns: part and place of a node's parent


def _parents(nodes: DataFrame, parent: tuple) -> DataFrame:
    part, place = parent
    child = F.struct(F.col("part").alias("p"), F.col("place").alias("q"), "size", "hash")
    met = nodes.groupBy(part.alias("up"), place.alias("at")).agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(child)).alias("children"))
    spelled = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["p"], c["q"], c["size"], c["hash"])), ",")
    return met.select(F.col("up").alias("part"), F.col("at").alias("place"), "size", F.sha2(spelled, 256).alias("hash"))


def shape(*manifests: DataFrame) -> tuple[int, int, int]:
    """Largest place, smallest and largest file of some manifests, which trees to be compared must share."""
    every = manifests[0].select("place", "file")
    for m in manifests[1:]:
        every = every.union(m.select("place", "file"))
    top, first, last = every.agg(F.max("place"), F.min("file"), F.max("file")).first()
    return top or 0, first or 0, last or 0


def tree(rows: DataFrame, top: int, first: int, last: int) -> list[Level]:
    """Levels from the slots to the root, for files ``first`` to ``last`` of up to ``top + 1`` slots."""
    part, place = F.col("part"), F.col("place")
    nodes = leaves(rows)
    levels = []
    while top > 0:
        levels.append(Level(nodes, up := (part, F.floor(place / FANOUT).cast("long"))))
        nodes, top = checkpoint(_parents(nodes, up)), top // FANOUT
    while last - first >= FANOUT:
        levels.append(Level(nodes, up := (F.floor(part / FANOUT).cast("long"), place)))
        nodes, first, last = checkpoint(_parents(nodes, up)), first // FANOUT, last // FANOUT
    levels.append(Level(nodes, up := (F.lit(0).cast("long"), F.lit(0).cast("long"))))
    return [*levels, Level(checkpoint(_parents(nodes, up)), ())]


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, file, place, start, stop, status, expected, found of each slot in which two manifests differ.

    ``status`` is ``missing`` (no record in the replica), ``added`` (none in
    the original) or ``changed``; offsets are the original's, or the replica's
    for what was added. Records that share an id are one slot. Two empty
    manifests, or equal ones, give no rows.
    """
    original, replica = stored(original), stored(replica)
    whole = shape(original, replica)
    a, b = tree(original, *whole), tree(replica, *whole)
    suspects = None
    for one, other in zip(reversed(a), reversed(b), strict=True):
        sides = []
        for level, tag in ((one, "x"), (other, "y")):
            nodes = level.nodes
            if suspects is not None:
                up = suspects.select(F.col("part").alias("up"), F.col("place").alias("at"))
                nodes = nodes.join(up, (level.parent[0] == F.col("up")) & (level.parent[1] == F.col("at")), "left_semi")
            sides.append(nodes.select("part", "place", F.col("hash").alias(f"hash_{tag}")))
        met = sides[0].join(sides[1], ["part", "place"], "full")
        suspects = checkpoint(met.where(~F.col("hash_x").eqNullSafe(F.col("hash_y"))))
    status = F.when(F.col("hash_y").isNull(), "missing").when(F.col("hash_x").isNull(), "added").otherwise("changed")
    found = suspects.select(F.col("part").alias("file"), "place", status.alias("status"), F.col("hash_x").alias("expected"), F.col("hash_y").alias("found"))
    slot = lambda m: m.groupBy("file", "place").agg(F.max("page_id").alias("page_id"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    named = slot(original).join(found.where("status <> 'added'"), ["file", "place"])
    added = slot(replica).join(found.where("status = 'added'"), ["file", "place"])
    return named.unionByName(added).select("page_id", "file", "place", "start", "stop", "status", "expected", "found")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: some pages' first character overwritten, some records lost."""
    lost = F.coalesce(F.pmod("page_id", F.lit(2003)) == 1999, F.lit(False))
    rotten = F.coalesce(F.pmod("page_id", F.lit(97)) == 13, F.lit(False))
    return pages.where(~lost).withColumn("html", F.when(rotten, F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))


def fixity_audit(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Audit the records of ``pages`` against a replica with known damage.

    Null and repeated ids, null urls and texts, long records and empty tables
    are as in ``manifest``; columns besides page_id, url and html are ignored.
    """
    return audit(manifest(pages, per_file), manifest(damaged(pages), per_file))


def _sql_manifest(html: str, where: str) -> str:
    return f"""
  SELECT page_id, sum(size) OVER w - size AS start, sum(size) OVER w AS stop, hash FROM (
    SELECT page_id, sha256(r) AS hash, strlen(r) AS size FROM (
      SELECT page_id, 'WARC/1.1' || n || 'WARC-Type: response' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(h) || n || n || h || n || n AS r
      FROM (SELECT page_id, url, chr(13) || chr(10) AS n, {html} AS h FROM pages WHERE {where})))
  WINDOW w AS (PARTITION BY page_id // {PER_FILE} ORDER BY page_id, hash ROWS UNBOUNDED PRECEDING)"""


SQL = f"""
WITH a AS ({_sql_manifest("coalesce(html, '')", "true")}),
b AS ({_sql_manifest("CASE WHEN page_id % 97 = 13 THEN '~' || substr(html, 2) ELSE coalesce(html, '') END", "page_id % 2003 <> 1999")})
SELECT page_id, page_id // {PER_FILE} AS file, page_id % {PER_FILE} AS place, CAST(coalesce(a.start, b.start) AS BIGINT) AS start, CAST(coalesce(a.stop, b.stop) AS BIGINT) AS stop,
  CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'added' ELSE 'changed' END AS status, a.hash AS expected, b.hash AS found
FROM a FULL JOIN b USING (page_id)
WHERE a.hash IS DISTINCT FROM b.hash
"""
