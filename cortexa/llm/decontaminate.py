"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with q distinct five-word shingles is contained in a document that has
at least ``need = ceil(0.8 q)`` of them. Such a document misses at most
``q - need``, so it holds one of *any* ``q - need + 1`` of the item's shingles.
Each item is sketched by the shingles with the smallest hash values, and items
are partitioned by size: all items of a size class keep as many minima as its
largest member needs. A document of any length is therefore found through the
sketches with certainty; what is found is verified by exact shingle containment.
An item of fewer than five words is one shingle of its own length: a document
contains it where its words stand consecutively.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE_A, WordHashes, checkpoint, doc_text, plain_words, rolling, signed, starts_of, text_chunks

SHINGLE, CONTAINMENT = 5, Fraction(4, 5)

#: A word, as ``plain_words`` takes them from text whose A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words of all items, and so at most as many shingles, up to which the items themselves go to every task (some
#: 150 bytes a shingle in each worker's sets); larger item sets are joined.
BROADCAST_WORDS = 500_000


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def size_of(words: list[bytes]) -> int:
    """Words of an item's shingles: five, or all of a shorter item."""
    return min(SHINGLE, len(words))


def size_class(q: int) -> int:
    """The largest size of the class that q falls in; classes end at 8, 10, 12, 14, 16, 20, 24, 28, 32, 40 and so on."""
    step = 1 << max(0, (q - 1).bit_length() - 3)
    return max(8, ceil(q / step) * step)


def sketch(words: list[bytes], hashes: WordHashes, containment: Fraction) -> np.ndarray:
    """The smallest distinct shingle hashes, as many as the item's size class needs."""
    values = np.unique(rolling(hashes.of(words), size_of(words), BASE_A))
    most = size_class(max(1, len(values)))
    return values[: most - ceil(containment * most) + 1]


def _usable(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")


def contained(docs: DataFrame, items: DataFrame, containment: Fraction = CONTAINMENT, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each document with at least ``containment`` of an item's shingles.

    Words are runs of letters and digits (any character above ASCII counts),
    A-Z lower-cased. Items without a word or an id match nothing, nor do null
    or empty documents; an item of one to four words has one shingle. Rows that
    repeat a doc_id are documents of their own, of which the best match is
    given; items that repeat an id likewise. All words of texts of any length
    count. Without documents or items there are no rows; other columns are
    ignored.
    """
    n = F.least(F.lit(SHINGLE), F.regexp_count("text", F.lit(WORDS)))
    items = _usable(items)
    by_size = {r["n"]: r["words"] for r in items.groupBy(n.alias("n")).agg(F.sum(F.regexp_count("text", F.lit(WORDS))).alias("words")).collect() if r["n"]}
    sizes = sorted(by_size)
    if not sizes:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long")
    elif sum(by_size.values()) <= broadcast_words:
        found = _scanned(docs, items, containment)
    else:
        found = _joined(docs, items, containment, sizes)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def _scanned(docs: DataFrame, items: DataFrame, containment: Fraction) -> DataFrame:
    """A single pass over the documents; the items, of bounded size, are in each task."""
    rows = [(x["item_id"], plain_words((x["text"] or "").encode())) for x in items.collect()]
    rows = docs.sparkSession.sparkContext.broadcast([(i, w) for i, w in rows if w])

    def of(batches):
        hashes = WordHashes()
        of_value: dict[int, dict] = defaultdict(lambda: defaultdict(list))  # by size, then by value
        sets = [(i, shingles(w, size_of(w))) for i, w in rows.value]
        for k, (_, words) in enumerate(rows.value):
            for value in sketch(words, hashes, containment).tolist():
                of_value[size_of(words)][value].append(k)
        tables = {size: np.sort(np.fromiter(x, np.uint64, len(x))) for size, x in of_value.items()}
        for batch, texts in text_chunks(batches):
            words = [plain_words(x) for x in texts]
            out = []
            for size, table in tables.items():
                for d, candidates in _hits(words, hashes, size, table, of_value[size]):
                    own = shingles(words[d], size)
                    for k in sorted(candidates):
                        item, whole = sets[k]
                        if (n := len(own & whole)) >= containment * len(whole):
                            out.append((batch.column(0)[d].as_py(), item, n, len(whole)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([],) * 4)], ["doc_id", "item_id", "n_shared", "n_item"])

    return doc_text(docs).mapInArrow(of, "doc_id long, item_id long, n_shared long, n_item long")


def _hits(words, hashes, size, table, of_value):
    """(document, items) for the documents of a chunk that hold a value of a sketch."""
    counts = np.array([len(x) for x in words])
    values = rolling(hashes.of([w for x in words for w in x]), size, BASE_A)
    at = np.nonzero(table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values)[0]
    doc = np.searchsorted(np.cumsum(counts), at, side="right")
    inside = at + size <= (starts_of(counts) + counts)[doc]
    found = defaultdict(set)
    for d, value in zip(doc[inside].tolist(), values[at[inside]].tolist(), strict=True):
        found[d].update(of_value[value])
    return found.items()


def _joined(docs: DataFrame, items: DataFrame, containment: Fraction, sizes: list[int]) -> DataFrame:
    """The same by joins, for item sets of any size; equal texts are looked up and verified once.

    Only items that share a sketch value with a text are compared with it: each
    asks the text for its own shingles, so a shingle that many documents and
    many items have makes no rows beyond the pairs that were found.
    """

    def each(names, pick):
        """Rows of the first columns, repeated for every value that ``pick`` finds in the text, the last one."""

        def of(batches):
            hashes = WordHashes()
            for batch, texts in text_chunks(batches, column=len(names)):
                found, kind = pick([plain_words(x) for x in texts], hashes)
                n = [len(x) for x in found]
                keys = [batch.column(k).take(pa.array(np.repeat(np.arange(len(n)), n))) for k in range(len(names))]
                flat = pa.array([v for x in found for v in x], kind)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.repeat(n, n)), flat], [*names, "n", "value"])

        return of

    def sketches(texts, hashes):
        return [signed(sketch(w, hashes, containment)).tolist() if w else [] for w in texts], pa.int64()

    def values(texts, hashes):
        return [signed(np.unique(np.concatenate([rolling(h, size, BASE_A) for size in sizes]))).tolist() for h in map(hashes.of, texts)], pa.int64()

    def own_shingles(texts, hashes):
        return [sorted(shingles(w, size_of(w))) if w else [] for w in texts], pa.binary()

    def all_shingles(texts, hashes):
        return [sorted(set().union(*(shingles(w, size) for size in sizes))) for w in texts], pa.binary()

    key = F.sha2(F.coalesce("text", F.lit("")), 256)  # equal keys, equal texts
    rows = doc_text(docs).withColumn("doc_key", key)
    texts = items.withColumn("item_key", key)
    index = texts.select("item_id", "item_key", "text").mapInArrow(each(["item_id", "item_key"], sketches), "item_id long, item_key string, n long, value long")
    probes = rows.select("doc_key", "text").mapInArrow(each(["doc_key"], values), "doc_key string, n long, value long")
    pairs = checkpoint(probes.select("doc_key", "value").distinct().join(index.select("item_id", "item_key", "value").distinct(), "value").select("doc_key", "item_id", "item_key").distinct())
    some = rows.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi")
    own = some.select("doc_key", "text").mapInArrow(each(["doc_key"], all_shingles), "doc_key string, n long, value binary").select("doc_key", "value").distinct()
    whole = texts.select("item_id", "item_key", "text").mapInArrow(each(["item_id", "item_key"], own_shingles), "item_id long, item_key string, n_item long, value binary").distinct()
    shared = pairs.join(whole, ["item_id", "item_key"]).join(own, ["doc_key", "value"]).groupBy("doc_key", "item_id", "item_key").agg(F.count("*").alias("n_shared"), F.max("n_item").alias("n_item"))
    verified = shared.where(F.col("n_shared") * containment.denominator >= F.col("n_item") * containment.numerator)
    return some.select("doc_id", "doc_key").join(verified, "doc_key").select("doc_id", "item_id", "n_shared", "n_item")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), z AS (SELECT DISTINCT least(5, len(w)) AS z FROM i WHERE len(w) > 0),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + z - 1], ' ') AS s FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM d, z)
), s AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + z - 1], ' ') AS s FROM (SELECT item_id, w, least(5, len(w)) AS z, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 5 >= n_item * 4
"""
