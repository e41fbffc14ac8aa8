"""Substring deduplication by relative Lempel-Ziv parsing against the whole corpus.

The corpus is its own reference. It is cut into overlapping blocks at places
that the words themselves choose: a window of 20 words is anchored at its
six-word phrase with the smallest hash, and consecutive windows with one anchor
make a block (34 words at most). Equal passages are cut alike wherever they
stand. The reference index has each distinct block once, where it stands first.

1. Whole blocks. Every block is looked up in the index; one that is there
   already is copied as a whole.
2. Extension. Any other block whose anchor is known reads that anchor's reference
   block, the first of them all, and is compared with it word by word, from the
   anchor to the right and to the left, as far as both go on alike. 20 words or
   more are copied.
3. Boundaries. A window of the block beyond that cannot be in the reference
   block, but in another one with the anchor. These windows, and no others, are
   looked up one by one.
4. Parse. Each document is read from its start. At a place that has a copy, the
   factor goes on through whole and extended blocks for as long as their copies
   stand one behind the other in one document; the parse goes on behind it. A
   place without a copy is one literal word. Factors, 20 words or more, are
   duplicate spans; a copied window across a factor's boundary is in no factor
   and goes as well.

Reference blocks are compared as words; whole blocks by two 64-bit hashes made
from different halves of the words' 128-bit hashes, windows by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import BASE_A, BASE_B, doc_text, mixed, partitions, rolling, signed, starts_of, stored, text_chunks

WINDOW, PHRASE = 20, 6

#: What a factor has.
FACTOR = ("start", "size", "ref_id", "ref_start")

#: Text bytes of a slice of the table that is deduplicated within its task first.
SLICE = 4 << 20


class WordDigests(dict):
    """128-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_128_digest(word)
        return value

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of the words' hashes."""
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


class Blocks:
    """The blocks of a chunk of documents; arrays have one entry for each block."""

    def __init__(self, texts: list[bytes], hashes: WordDigests, window: int = WINDOW, phrase: int = PHRASE):
        words = [x.split() for x in texts]
        self.counts = np.array([len(x) for x in words], np.int64)
        self.starts = starts_of(self.counts)
        values, others = hashes.of([w for x in words for w in x])
        self.windows = np.maximum(self.counts - window + 1, 0)
        of_doc = np.repeat(np.arange(len(words)), self.windows)
        self.at = np.arange(len(of_doc)) - starts_of(self.windows)[of_doc] + self.starts[of_doc]  # each window's first word
        if not len(of_doc):
            self.doc = self.start = self.size = self.lead = np.zeros(0, np.int64)
            self.run = np.zeros(0, np.int64)
            self.anchor = self.block = self.first = self.second = np.zeros(0, np.uint64)
            return
        phrases = mixed(rolling(values, phrase, BASE_A))
        place = _least(phrases, window - phrase + 1)[self.at]  # where each window's anchor stands
        new = np.append(True, (place[1:] != place[:-1]) | (of_doc[1:] != of_doc[:-1]))
        run = np.nonzero(new)[0]
        self.doc, self.start = of_doc[run], self.at[run] - self.starts[of_doc[run]]
        self.size = np.diff(np.append(run, len(of_doc)))
        self.anchor, self.lead = phrases[place[run]], place[run] - self.at[run]
        self.first, self.second = rolling(values, window, BASE_A)[self.at], mixed(rolling(others, window, BASE_B))[self.at]
        # A block's words are those of its windows: their hashes in turn tell it from others.
        terms = self.second * (2 * np.arange(len(of_doc), dtype=np.uint64) - 2 * np.repeat(run, self.size).astype(np.uint64) + np.uint64(1))
        self.block = mixed(np.add.reduceat(terms, run) ^ mixed(self.size.astype(np.uint64)))
        self.run = run


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest of each ``size`` consecutive values, the last of equal ones."""
    place, width = np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        a, b = place[:-step], place[step:]
        place = np.where(values[a] < values[b], a, b)
        width += step
    return place


def _repeats(order: np.ndarray, keys: tuple[np.ndarray, ...], ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in ``order`` (by keys, id, row and start): which have an earlier equal one among these, and its place in the order."""
    if not len(order):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    head = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = ids[order] > ids[order][first]
    own = ~head & np.append(False, rows[order][1:] == rows[order][:-1])
    return later | own, np.where(later, first, np.maximum(np.arange(len(order)) - 1, 0))


def _alone(keys: np.ndarray, again: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys to deal by; entries that are decided already need no company, so each gets a key of its own."""
    return np.where(again, mixed(keys + at.astype(np.uint64) * np.uint64(BASE_B)), keys)


#: Whether an earlier copy stood in the same slice of the table, and where.
KNOWN = "again boolean, ref_id long, ref_start int"


def _blocks(docs: DataFrame) -> DataFrame:
    """anchor, block, doc_id, start, size of every block, and KNOWN."""

    def of(batches):
        hashes = WordDigests()
        for batch, texts in text_chunks(batches, limit=SLICE):
            b, ids = Blocks(texts, hashes), batch.column(0).to_numpy()
            own = ids[b.doc]
            order = np.lexsort((b.start, b.doc, own, b.block))
            again, ref = _repeats(order, (b.block, b.anchor), own, b.doc)
            own, start = own[order], b.start[order].astype(np.int32)
            out = [signed(_alone(b.anchor[order], again, b.at[b.run][order])), signed(b.block)[order], own, start, b.size[order].astype(np.int32), again, own[ref], start[ref]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor", "block", "doc_id", "start", "size", "again", "ref_id", "ref_start"])

    return docs.mapInArrow(of, f"anchor long, block long, doc_id long, start int, size int, {KNOWN}")


def _listed(rows: DataFrame) -> DataFrame:
    """anchor, doc_id, start, lead (words before the anchor), leads and words of the blocks that start at ``places``."""

    def of(batches):
        hashes = WordDigests()
        for batch, texts in text_chunks(batches, limit=SLICE):
            b, ids = Blocks(texts, hashes), batch.column(0).to_numpy()
            wanted = {(d, x["start"]): x["leads"] for d, places in enumerate(batch.column(2).to_pylist()) for x in places}
            split, of_doc, out = [], -1, []
            for k, (d, start) in enumerate(zip(b.doc.tolist(), b.start.tolist(), strict=True)):
                if (d, start) in wanted:
                    if d != of_doc:
                        split, of_doc = texts[d].split(), d
                    words = b" ".join(split[start : start + int(b.size[k]) + WINDOW - 1])
                    out.append((int(signed(b.anchor[k : k + 1])[0]), int(ids[d]), start, int(b.lead[k]), wanted[d, start], words))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            arrays = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "start", "lead", "leads", "words"])

    return rows.mapInArrow(of, "anchor long, doc_id long, start int, lead int, leads boolean, words binary")


def extent(words: list[bytes], lead: int, other: list[bytes], other_lead: int) -> tuple[int, int]:
    """How many words before and from the anchor on two blocks have in common."""
    left, right = min(lead, other_lead), min(len(words) - lead, len(other) - other_lead)
    before = next((i for i in range(left) if words[lead - 1 - i] != other[other_lead - 1 - i]), left)
    behind = next((i for i in range(right) if words[lead + i] != other[other_lead + i]), right)
    return (before, behind) if behind >= PHRASE else (0, 0)  # else another phrase with the anchor's hash


def _extended(pairs: DataFrame) -> DataFrame:
    """doc_id, start, size, ref_id, ref_start of the windows that a block shares with its reference block (null: none), and the block's other windows."""

    def of(batches):
        for batch in batches:
            rows, out = [x.to_pylist() for x in batch.columns], []
            for doc_id, start, lead, words, ref_id, ref_start, ref_lead, ref_words in zip(*rows, strict=True):
                words = words.split(b" ")
                before, behind = extent(words, lead, ref_words.split(b" "), ref_lead)
                size = max(0, before + behind - WINDOW + 1)
                first = lead - before
                others = [i for i in range(len(words) - WINDOW + 1) if not first <= i < first + size]
                digests = [np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW])), np.int64).tolist() for i in others]
                rest = [{"first": x, "second": y, "start": start + i} for i, (x, y) in zip(others, digests, strict=True)]
                out.append((doc_id, *((start + first, size, ref_id, ref_start + ref_lead - before) if size else (None,) * 4), rest))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.struct([("first", pa.int64()), ("second", pa.int64()), ("start", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    names = ["doc_id", "start", "size", "ref_id", "ref_start", "rest"]
    return pairs.mapInArrow(of, "doc_id long, start int, size int, ref_id long, ref_start int, rest array<struct<first: long, second: long, start: int>>")


def _looked_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``copied`` and the place of the copy, from the slice or from the first of all rows with the keys."""
    best = F.min(F.struct("doc_id", "start")).over(Window.partitionBy(*keys))
    rows = rows.withColumn("best", best).withColumn("copied", F.expr("again or best.doc_id < doc_id"))
    return rows.withColumns({"ref_id": F.expr("if(again, ref_id, best.doc_id)"), "ref_start": F.expr("if(again, ref_start, best.start)")}).drop("best")


def duplicate_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents dealt by id, and doc_id, start, size, ref_id, ref_start: runs of ``size`` windows and where an earlier copy stands.

    A slice of the table looks up its own blocks first. What is decided there
    is dealt out evenly, so of a passage that a third of all documents share
    one row a slice goes by its hash. Blocks meet their reference in a join with
    one row for each anchor, whose other side Spark can split.
    """
    text = doc_text(docs).where("doc_id is not null")
    dealt = text.repartition(partitions(docs.sparkSession), "doc_id")
    anchored = Window.partitionBy("anchor")
    rows = _looked_up(_blocks(text).repartition(partitions(docs.sparkSession), "anchor"), ["anchor", "block"])
    rows = rows.withColumn("differs", F.min("block").over(anchored) < F.max("block").over(anchored))
    rows = rows.withColumn("leads", F.struct("doc_id", "start") == F.min(F.struct("doc_id", "start")).over(anchored))
    met = stored(rows.where("copied or differs").select("doc_id", "start", "size", "copied", "leads", "ref_id", "ref_start"))
    places = met.where("not copied").groupBy("doc_id").agg(F.collect_list(F.struct("start", "leads")).alias("places"))
    listed = stored(_listed(dealt.join(places, "doc_id")))
    references = listed.where("leads").dropDuplicates(["anchor"])  # rows that share an id list theirs twice
    references = references.select("anchor", F.col("doc_id").alias("ref_id"), F.col("start").alias("ref_start"), F.col("lead").alias("ref_lead"), F.col("words").alias("ref_words"))
    references = stored(references)  # so that nothing but a shuffle lies below the join, which Spark can then split
    pairs = listed.where("not leads").join(references, "anchor").select("doc_id", "start", "lead", "words", "ref_id", "ref_start", "ref_lead", "ref_words")
    compared = stored(_extended(pairs))
    windows = compared.select("doc_id", F.inline("rest"))
    firsts = windows.groupBy("first", "second").agg(F.min(F.struct("doc_id", "start")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(firsts, ["first", "second"]).where("best < struct(doc_id, start)")
    single = single.select("doc_id", "start", F.lit(1).alias("size"), F.col("best.doc_id").alias("ref_id"), F.col("best.start").alias("ref_start"))
    spans = met.where("copied").select("doc_id", "start", "size", "ref_id", "ref_start")
    return dealt, spans.union(compared.where("size is not null").drop("rest")).union(single)


def parsed(found: np.ndarray, ref_id: np.ndarray, ref_start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each factor of a greedy parse, from which windows have a copy and where."""
    goes_on = found[1:] & found[:-1] & (ref_id[1:] == ref_id[:-1]) & (ref_start[1:] == ref_start[:-1] + 1)
    ends = np.nonzero(found & ~np.append(goes_on, False))[0]
    known = np.nonzero(found)[0]
    first, last, at = [], [], 0
    while (k := np.searchsorted(known, at)) < len(known):
        start = int(known[k])
        end = int(ends[np.searchsorted(ends, start)])
        first.append(start)
        last.append(end)
        at = end + window  # the first word behind the factor
    return np.array(first, np.int64), np.array(last, np.int64)


def removed(n_words: int, found: np.ndarray, first: np.ndarray, last: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words the factors cover, or windows with a copy across the factors' boundaries."""
    change = np.zeros(n_words + 1, np.int64)
    inside = np.zeros(len(found) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    np.add.at(change, first, 1)
    np.add.at(change, last + window, -1)
    across = np.nonzero(found & (np.cumsum(inside)[:-1] == 0))[0]
    np.add.at(change, across, 1)
    np.add.at(change, across + window, -1)
    return np.cumsum(change)[:n_words] > 0


def substring_dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors, longest_factor and (with ``texts``) kept_text and factors of every row of ``docs``.

    ``factors`` has the start and size of each factor in words, and where its
    copy stands (ref_id, ref_start). Null and empty texts have no words. A
    window's earlier copy stands in a document with a smaller id, or earlier in
    the same row; rows that share an id have one text and do not count as
    earlier than one another, and rows without an id keep all their words.
    Other columns are ignored; an empty table gives none.
    """
    dealt, spans = duplicate_spans(docs)
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "ref_id", "ref_start")).alias("spans"))

    def of(batches):
        for batch, held in text_chunks(batches):
            out, lists = [], batch.column(2)
            many = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            start, size, ref_id, ref_start = (flat.field(x).to_numpy() for x in ("start", "size", "ref_id", "ref_start"))
            for text, k, stop in zip(held, np.cumsum(many) - many, np.cumsum(many), strict=True):
                words = text.split()
                windows = max(0, len(words) - WINDOW + 1)
                found, ids, places = np.zeros(windows, bool), np.zeros(windows, np.int64), np.zeros(windows, np.int64)
                steps = np.arange(size[k:stop].sum()) - np.repeat(starts_of(size[k:stop]), size[k:stop])
                at = np.repeat(start[k:stop], size[k:stop]) + steps
                found[at], ids[at], places[at] = True, np.repeat(ref_id[k:stop], size[k:stop]), np.repeat(ref_start[k:stop], size[k:stop]) + steps
                first, last = parsed(found, ids, places)
                gone = removed(len(words), found, first, last)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
                sizes = last - first + WINDOW
                row = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), len(sizes), int(sizes.max(initial=0)))
                if texts:
                    row += (kept.decode(), [dict(zip(FACTOR, x, strict=True)) for x in zip(first.tolist(), sizes.tolist(), ids[first].tolist(), places[first].tolist(), strict=True)])
                out.append(row)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([(x, pa.int64()) for x in FACTOR])))[: 7 if texts else 5]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, longest_factor long"
    schema += ", kept_text string, factors array<struct<" + ", ".join(f"{x}: long" for x in FACTOR) + ">>" if texts else ""
    names = [x.split()[0] for x in schema.split(", ")[: 8 if texts else 6]]
    known = dealt.join(grouped, "doc_id", "left").mapInArrow(of, schema)
    unnamed = doc_text(docs).where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<start:int,size:int,ref_id:long,ref_start:int>>"))
    return known.union(unnamed.mapInArrow(of, schema))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM t),
h AS (SELECT doc_id, k, w[k:k + 19] AS win FROM s),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS rn FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM f WHERE rn > 1),
x AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
y AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM t LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(list_transform(kept, lambda i: w[i]), ' ')) AS kept_sha256 FROM y
"""
