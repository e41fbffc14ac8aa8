"""Line deduplication that can be taken back, by sharded cuckoo filters over exact reference counts.

An index of lines lies in a folder as tables:

- ``lines``: for each inserted document the digests of its lines, in their order;
  ``gone``: which documents have been deleted since;
- ``counts``: the exact table. For each line's key, in how many documents it
  stands and the largest id of these;
- ``filters``: for each shard of the keys a cuckoo filter of those that stand in
  enough documents to count as duplicates.

Documents may be inserted and deleted at any time. Both change the counts; keys
that reach the least number of documents enter their shard's filter, and keys
that fall below it are deleted from it, which cuckoo filters allow. So after a
deletion the index is as if the document had never been there.

To drop lines, every key is first looked up in the filters. What they let
through is decided by the exact table: keys that stand in more than a thousandth
of all (document, line) pairs, so at most a thousand, are held by every task, and
all others, none of which has more rows than that, are joined. Filters are
broadcast up to a number of bytes; beyond it all keys are joined.

Tasks count the lines of a slice before anything is shuffled, so a line that
every document holds leaves one row a slice. Keys are compared by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import discard, scratch_folder
from .common import doc_text, mixed, stored, text_chunks

LEAST_CHARS, LEAST_DOCS = 20, 3

BLANKS = b" \t\n\v\f\r"
KEY = ["k0", "k1"]

#: Bytes of digests that a task counts at a time.
SLICE = 16 << 20

#: Bytes of all filters, and of all lines to drop, up to which they are broadcast.
FILTER_BYTES, DROP_BYTES = 32 << 20, 16 << 20

#: A key of more than this share of all pairs is held by every task.
HOT_SHARE = 1000


class Cuckoo:
    """A cuckoo filter of 64-bit keys, with 16-bit fingerprints in buckets of four."""

    WAYS, KICKS = 4, 500

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """Room for so many keys at a load of at most 0.85."""
        return cls(np.zeros((1 << max(1, int(keys / (0.85 * cls.WAYS))).bit_length(), cls.WAYS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.WAYS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = np.maximum(keys >> np.uint64(48), np.uint64(1))
        mask = np.uint64(len(self.slots) - 1)
        first = mixed(keys) & mask
        return prints.astype(np.uint16), first.astype(np.int64), (first ^ (mixed(prints) & mask)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.slots[first] == prints[:, None]) | (self.slots[second] == prints[:, None])).any(1)

    def _swap(self, keys: np.ndarray, put: bool) -> np.ndarray:
        """Put the keys' prints into empty slots, or empty slots that hold them, all keys at once; what is left over."""
        prints, *sides = self._places(keys)
        left = np.arange(len(keys))
        for side in sides:
            for way in range(self.WAYS):
                fits = left[self.slots[side[left], way] == (0 if put else prints[left])]
                _, one = np.unique(side[fits], return_index=True)  # a slot serves one key
                chosen = fits[one]
                self.slots[side[chosen], way] = prints[chosen] if put else 0
                left = np.setdiff1d(left, chosen, assume_unique=True)
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all keys found a place; if not, the filter is of no more use."""
        left = keys[self._swap(keys, put=True)]
        prints, first, _ = self._places(left)
        mask = len(self.slots) - 1
        hops = (mixed(np.arange(1 << 16, dtype=np.uint64)) & np.uint64(mask)).astype(np.int64) if len(left) else None
        for p, at in zip(prints.tolist(), first.tolist(), strict=True):
            for kick in range(self.KICKS):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = p
                    break
                way = kick % self.WAYS
                p, self.slots[at, way] = int(self.slots[at, way]), p
                at ^= int(hops[p])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that have been inserted."""
        if len(self._swap(keys, put=False)):
            raise KeyError("a key to delete is not in the filter")


def line_keys(text: bytes, least: int = LEAST_CHARS) -> tuple[bytes, list[int]]:
    """The digests (16 bytes each) of a text's lines that have keys of ``least`` code points, and their numbers."""
    at, digests = [], []
    for i, line in enumerate(text.lower().split(b"\n")):
        line = line.strip(BLANKS)
        if len(line) >= least and (line.isascii() or len(line.decode()) >= least):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(line))
    return b"".join(digests), at


def _row(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``alt``, a hash of the text: rows that share an id are told apart by it."""
    return doc_text(docs).withColumn("alt", F.xxhash64(F.coalesce("text", F.lit(""))))


def parsed(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, alt, the digests and the numbers of every row's lines; rows without a line that is long enough are left out."""

    def of(batches):
        for batch, texts in text_chunks(batches):
            found = [line_keys(x, least) for x in texts]
            some = [i for i, x in enumerate(found) if x[1]]
            picked = batch.select(["doc_id", "alt"]).take(pa.array(some, pa.int64()))
            arrays = [pa.array([found[i][0] for i in some], pa.binary()), pa.array([found[i][1] for i in some], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*picked.columns, *arrays], ["doc_id", "alt", "digests", "at"])

    return _row(docs).mapInArrow(of, "doc_id long, alt long, digests binary, at array<int>")


def _digests(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all rows, two columns, and each one's row."""
    return np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2), np.repeat(np.arange(len(held)), [len(x) // 16 for x in held])


def counted(lines: DataFrame) -> DataFrame:
    """k0, k1, docs, last: the keys of each slice of the table, the rows that hold one, and the largest of their ids."""

    def of(batches):
        for batch, held in text_chunks(batches, column=2, limit=SLICE):
            keys, row = _digests(held)
            ids = batch.column(0)
            given, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            # By key and row, those without an id first, then by id: the last of a key's rows has the largest one.
            order = np.lexsort((row, ids[row], given[row], keys[:, 1], keys[:, 0]))
            keys, row = keys[order], row[order]
            other = np.append(True, (keys[1:] != keys[:-1]).any(1)) if len(keys) else np.zeros(0, bool)
            fresh = other | np.append(True, row[1:] != row[:-1])[: len(row)]
            starts = np.flatnonzero(other)
            last = row[np.append(starts[1:], len(row)) - 1]
            docs = np.add.reduceat(fresh.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
            arrays = [pa.array(keys[starts, 0].view(np.int64)), pa.array(keys[starts, 1].view(np.int64)), pa.array(docs), pa.array(ids[last], pa.int64(), mask=~given[last])]
            yield pa.RecordBatch.from_arrays(arrays, ["k0", "k1", "docs", "last"])

    return lines.mapInArrow(of, "k0 long, k1 long, docs long, last long")


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


class LineIndex:
    """The index in ``folder`` (shared by driver and executors): opened where there is one, else begun with the given parameters.

    ``shards`` says into how many filters the keys are dealt; by default one for
    each million lines of what is inserted first.
    """

    STATE = "version long, batch long, shards long, pairs long, least_chars int, least_docs int, filters long, gone boolean"

    def __init__(self, spark: SparkSession, folder: str, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shards: int = 0, fresh: bool = False):
        self.spark, self.folder = spark, folder
        self.version = self.batch = self.pairs = self.filters = 0
        self.least_chars, self.least_docs, self.shards, self.gone = least_chars, least_docs, shards, False
        if not fresh:
            for name, value in spark.read.parquet(f"{folder}/state").orderBy(F.desc("version")).first().asDict().items():
                setattr(self, name, value)

    @classmethod
    def begun(cls, spark: SparkSession, folder: str, **parameters) -> LineIndex:
        return cls(spark, folder, fresh=True, **parameters)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def counts(self) -> DataFrame:
        """k0, k1, docs and last of every key."""
        return self._read(f"counts-{self.version}")

    def live(self) -> DataFrame:
        """The lines of the documents that are in the index now."""
        rows = self._read("lines/*").where(F.col("batch") <= self.batch)
        if not self.gone:
            return rows
        gone = self._read("gone").where(F.col("through") <= self.batch).groupBy("doc_id").agg(F.max("through").alias("through")).withColumnRenamed("doc_id", "gone_id")
        return rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("batch") <= F.col("through")), "left_anti")

    def _duplicates(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("docs") >= self.least_docs)

    def _shard(self):
        return F.pmod("k1", F.lit(self.shards))

    def _commit(self, counts: DataFrame, changed: DataFrame | None) -> None:
        """A new version from the counts, and of filters from the keys whose counts have ``changed`` (k0, k1, before; null: all of them)."""
        old, self.version = self.version, self.version + 1
        counts.write.mode("overwrite").parquet(f"{self.folder}/counts-{self.version}")
        counts = self.counts()
        sizes = {r["shard"]: r["n"] for r in self._duplicates(counts).groupBy(self._shard().alias("shard")).agg(F.count("*").alias("n")).collect()}  # one row a shard
        held = {r["shard"]: r["room"] for r in self._read(f"filters-{old}").select("shard", (F.length("slots") / 2).alias("room")).collect()} if old else {}
        grown = {s: n for s, n in sizes.items() if n > 0.9 * held.get(s, 0)} if changed is not None else dict(sizes)
        empty = self.spark.createDataFrame([], "shard long, slots binary")
        keys = self._duplicates(counts).select(*KEY, F.lit(True).alias("enters"))
        if changed is None:
            found, kept = keys, empty
        else:
            is_in = self._shard().isin(list(grown))
            crossing = changed.join(counts.select(*KEY, "docs"), KEY, "left").withColumn("enters", F.coalesce(F.col("docs"), F.lit(0)) >= self.least_docs)
            crossing = crossing.where((F.col("before") >= self.least_docs) != F.col("enters")).select(*KEY, "enters")
            found = crossing.where(~is_in).union(keys.where(is_in))
            kept = self._read(f"filters-{old}").where(~F.col("shard").isin(list(grown)))
        name, done = f"filters-{self.version}", False
        while not done:  # a filter in which a key finds no place is made anew, twice as large
            self._filled(found, kept, grown).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            full = [r["shard"] for r in self._read(name).where("slots IS NULL").select("shard").collect()]
            grown |= {s: 2 * max(grown.get(s, 0), sizes.get(s, 0)) for s in full}
            is_in = self._shard().isin(full)
            found, kept, done = found.where(~is_in).union(keys.where(is_in)), kept.where(~F.col("shard").isin(full)), not full
        self.filters = self._read(name).agg(F.coalesce(F.sum(F.length("slots")), F.lit(0)).alias("n")).first()["n"]
        state = [(self.version, self.batch, self.shards, self.pairs, self.least_chars, self.least_docs, self.filters, self.gone)]
        self.spark.createDataFrame(state, self.STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
        if old:
            discard(self.spark, f"{self.folder}/counts-{old}")
            discard(self.spark, f"{self.folder}/filters-{old}")

    def _filled(self, found: DataFrame, kept: DataFrame, grown: dict[int, int]) -> DataFrame:
        """shard and slots (null: full) of the kept filters with the found keys put in or taken out, and of new ones for shards in ``grown``."""

        def of(key, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            shard = int(key[0])
            cuckoo = Cuckoo.load(old["slots"].iloc[0]) if len(old) else Cuckoo.sized(grown.get(shard, 1))
            values, enters = keys["k0"].to_numpy(np.int64).view(np.uint64), keys["enters"].to_numpy(bool)
            cuckoo.delete(values[~enters])
            fits = cuckoo.insert(values[enters])
            return pd.DataFrame({"shard": [shard], "slots": [cuckoo.dump() if fits else None]})

        keyed = found.select(self._shard().alias("shard"), "k0", "enters")
        return keyed.groupBy("shard").cogroup(kept.groupBy("shard")).applyInPandas(of, "shard long, slots binary")

    def insert(self, docs: DataFrame) -> None:
        """Add rows of documents; ids that the index already has count as further documents."""
        self.batch += 1
        lines = f"{self.folder}/lines/{self.batch}"
        parsed(docs, self.least_chars).withColumn("batch", F.lit(self.batch)).write.mode("overwrite").parquet(lines)
        rows = self.spark.read.parquet(lines)
        n = rows.agg(F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("n")).first()["n"]
        self.pairs += n
        self.shards = self.shards or max(16, n >> 20)
        more = _added(counted(rows))
        if not self.version:
            return self._commit(more, None)
        more, old = stored(more), self.counts()
        changed = more.select(*KEY).join(old.select(*KEY, F.col("docs").alias("before")), KEY, "left").fillna(0, ["before"])
        self._commit(_added(old.union(more)), changed)

    def delete(self, ids: DataFrame) -> None:
        """Take out all documents with these ids (documents without one cannot be named)."""
        ids = stored(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
        leaving = self.live().join(ids, "doc_id", "left_semi")
        self.pairs -= leaving.agg(F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("n")).first()["n"]
        less = stored(_added(counted(leaving)).select(*KEY, F.col("docs").alias("less"), F.col("last").alias("had")))
        old = self.counts()
        # The largest id of a key is looked for anew where it leaves.
        orphans = stored(old.join(less, KEY).where("last = had AND docs > less").select(*KEY))
        ids.withColumn("through", F.lit(self.batch)).write.mode("append").parquet(f"{self.folder}/gone")
        self.gone = True
        heirs = counted(self.live()).join(orphans, KEY, "left_semi").groupBy(*KEY).agg(F.max("last").alias("heir")).withColumn("orphan", F.lit(True))
        rows = old.join(less, KEY, "left").join(heirs, KEY, "left")
        rows = rows.select(*KEY, F.expr("docs - coalesce(less, 0)").alias("docs"), F.expr("if(orphan, heir, last)").alias("last")).where("docs > 0")
        self._commit(rows, less.select(*KEY).join(old.select(*KEY, F.col("docs").alias("before")), KEY))

    def drops(self, filter_bytes: int = FILTER_BYTES, hot_share: int = HOT_SHARE) -> DataFrame:
        """doc_id, alt and ``gone``, the numbers of the lines to drop, of the documents in the index."""
        counts = self._duplicates(self.counts())
        hot = counts.where(F.col("docs") > self.pairs / hot_share).collect()  # at most hot_share rows, as documents of a key are pairs of its own
        held = {(r["k0"], r["k1"]): r["last"] for r in hot}
        use = self.filters <= filter_bytes
        sent = self.spark.sparkContext.broadcast({r["shard"]: r["slots"] for r in self._read(f"filters-{self.version}").collect()} if use else {})
        shards = self.shards

        def of(batches):
            filters = {s: Cuckoo.load(x) for s, x in sent.value.items()}
            hot0 = np.array(sorted(k[0] for k in held), np.int64)
            for batch, digests in text_chunks(batches, column=2, limit=SLICE):
                keys, row = _digests(digests)
                k0, k1 = keys[:, 0].copy().view(np.int64), keys[:, 1].copy().view(np.int64)
                maybe = np.full(len(keys), not use)
                if use:
                    shard = np.mod(k1, shards)
                    order = np.argsort(shard, kind="stable")
                    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                    for s, cuckoo in filters.items():
                        pick = order[bounds[s] : bounds[s + 1]]
                        maybe[pick] = cuckoo.has(keys[pick, 0])
                picked = np.flatnonzero(maybe)
                ids, at = batch.column(0).to_pylist(), batch.column(3).flatten().to_numpy()
                done: dict[int, list] = {}
                still = np.ones(len(picked), bool)
                for j in np.flatnonzero(np.isin(k0[picked], hot0)).tolist():
                    i = int(picked[j])
                    key = (int(k0[i]), int(k1[i]))
                    if key in held:
                        still[j] = False
                        if ids[row[i]] != held[key]:
                            done.setdefault(int(row[i]), []).append(int(at[i]))
                picked = picked[still]
                starts = np.searchsorted(row[picked], np.arange(len(ids) + 1))
                some = [i for i in range(len(ids)) if i in done or starts[i] < starts[i + 1]]
                open_ = [[{"k0": int(k0[x]), "k1": int(k1[x]), "at": int(at[x])} for x in picked[starts[i] : starts[i + 1]]] for i in some]
                kept = batch.select(["doc_id", "alt"]).take(pa.array(some, pa.int64()))
                kind = pa.list_(pa.struct([("k0", pa.int64()), ("k1", pa.int64()), ("at", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([done.get(i, []) for i in some], pa.list_(pa.int32())), pa.array(open_, kind)], ["doc_id", "alt", "done", "open"])

        found = stored(self.live().select("doc_id", "alt", "digests", "at").mapInArrow(of, "doc_id long, alt long, done array<int>, open array<struct<k0: long, k1: long, at: int>>"))
        asked = found.select("doc_id", "alt", F.inline("open")).join(counts.select(*KEY, "last"), KEY).where("NOT (doc_id <=> last)")
        return found.select("doc_id", "alt", F.explode("done").alias("at")).union(asked.select("doc_id", "alt", "at")).groupBy("doc_id", "alt").agg(F.collect_set("at").alias("gone"))

    def dedup(self, docs: DataFrame, texts: bool = True, drop_bytes: int = DROP_BYTES, **options) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 and (with ``texts``) kept_text of every row of ``docs``, which the index holds.

        Of a line that stands in enough documents, only the document with the
        largest id keeps its lines. Null and empty texts are one empty line;
        lines of any number and length are handled. Rows that share an id count
        as documents of their own and keep or lose a line together; a row
        without an id loses a line if any row with one holds it. A table without
        rows gives none; columns besides doc_id and text are ignored.
        """
        drops = stored(self.drops(**options))
        size = drops.agg(F.coalesce(F.sum(16 + 4 * F.size("gone")), F.lit(0)).alias("n")).first()["n"]
        drops = drops.select(F.col("doc_id").alias("of_id"), F.col("alt").alias("of_alt"), "gone")
        drops = F.broadcast(drops) if size <= drop_bytes else drops
        joined = _row(docs).join(drops, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("alt") == F.col("of_alt")), "left").select("doc_id", "text", "gone")

        def of(batches):
            for batch, held in text_chunks(batches):
                out = []
                for text, gone in zip(held, batch.column(2).to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    n, gone = len(lines), set(gone or ())
                    kept = b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text
                    out.append((n, len(gone), hashlib.sha256(kept).hexdigest(), *((kept.decode(),) if texts else ())))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 if texts else 3]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

        names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"][: 5 if texts else 4]
        return joined.mapInArrow(of, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if texts else ""))


def line_dedup(docs: DataFrame, texts: bool = True, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``LineIndex.dedup`` of ``docs`` among themselves, by an index of the session."""
    index = LineIndex.begun(docs.sparkSession, f"{scratch_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}", least_chars=least_chars, least_docs=least_docs)
    index.insert(docs)
    return index.dedup(docs, texts)


SQL = r"""
WITH t AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), s AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM t
), k AS (SELECT DISTINCT doc_id, unnest(keys) AS key FROM s),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(*) >= 3),
g AS (SELECT doc_id, list(key) AS gone FROM k JOIN m USING (key) WHERE doc_id <> last GROUP BY doc_id),
r AS (SELECT s.doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(coalesce(gone, []), keys[i])) AS kept FROM s LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(list_transform(kept, lambda i: lines[i]), chr(10)), '')) AS kept_sha256 FROM r
"""
