"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two 32-bit segments. Two fingerprints within 4 bits differ by
at most 2 in the first segment or by at most 1 in the second (otherwise they
would differ by 3 + 2). The small Hamming balls are split between both sides:
segments within 2 bits share a value of their radius-1 balls, and segments
within 1 bit agree once some bit is cleared. Each fingerprint is thus filed
under 33 + 32 keys; those filed together are fetched from the table of keys,
and their complete distances verified.

A key with more than ``bucket`` fingerprints is not compared pairwise. Its
fingerprints are filed under all 2,081 values within 2 bits of the *whole*
fingerprint: any two within 4 bits share such a value, and any two that share
one are within 4 bits, so a chain along each value holds every link at a cost
that is linear in the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import components
from .common import checkpoint, doc_text, partitions, text_chunks

SHINGLE, SEED, DISTANCE, BUCKET = 4, 42, 4, 4096

#: Fingerprints that a task files, 65 keys each.
FILED = 200_000


def fingerprint(text: bytes) -> int:
    """64 bits, each 1 if set in over half of the XXH64 values of the text's shingles."""
    words = text.lower().split()  # bytes: A-Z alone are lower-cased, and blanks are \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    values = np.array([digest(line[s:e], seed) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
    ones = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""

    def of(batches):
        for batch, texts in text_chunks(batches):
            values = np.array([fingerprint(x) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return doc_text(docs).mapInArrow(of, "doc_id long, fp long")


def linked(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what chains of fingerprints within ``distance`` connect: a member and the first of its chain."""
    left, firsts, members = values.view(np.uint64), [], []  # bits of signed values would be those of their size
    while len(left) > 1:
        first, left = left[0], left[1:]
        edge = left[:0]
        near = np.bitwise_count(left ^ first) <= distance
        edge, left = left[near], left[~near]
        while len(edge):
            firsts += [first] * len(edge)
            members.append(edge)
            if not len(left):
                break
            near = np.zeros(len(left), bool)
            for block in np.array_split(edge, max(1, len(edge) * len(left) // 1_000_000)):
                near |= (np.bitwise_count(left[None, :] ^ block[:, None]) <= distance).any(axis=0)
            edge, left = left[near], left[~near]
    return np.array(firsts, np.uint64).view(np.int64), np.concatenate([left[:0], *members]).view(np.int64)


def longs(values) -> Column:
    return F.lit([int(x) - (1 << 64) * (int(x) >> 63) for x in values]).cast("array<long>")


def filed(fps: DataFrame) -> DataFrame:
    """key, fp: each fingerprint under the keys of both segments."""
    fp, segment = F.col("fp"), F.lit(0xFFFFFFFF)
    ball = F.transform(longs([0, *(1 << i for i in range(32))]), lambda m: F.shiftrightunsigned(fp, 32).bitwiseXOR(m))
    bare = F.transform(longs(~(1 << i) % 2**64 for i in range(32)), lambda m, i: fp.bitwiseAND(segment).bitwiseAND(m) + (i + 1) * F.lit(1 << 32))
    return fps.select(F.explode(F.concat(ball, bare)).alias("key"), "fp")


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between different fingerprints that connect all that lie within ``distance`` (0, 2 or 4)."""
    if distance not in (0, 2, 4):
        raise ValueError("the distance is 0, 2 or 4 bits: twice the radius of the balls around both sides")
    keys = filed(fps)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = checkpoint(sizes)
    pairs = sizes.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    rest = sizes.where("n > 2").select("key", "n")
    fetched = checkpoint(keys.join(rest, "key"))

    def verified(batches):
        for batch in batches:
            for values in batch.column(0).to_pylist():
                a, b = linked(np.array(values, np.int64), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    groups = fetched.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    met = groups.select("fps").mapInArrow(verified, "a long, b long")
    out = pairs.union(met)
    large = fetched.where(F.col("n") > bucket).select("fp").distinct()
    if not large.isEmpty():
        out = out.union(chained(large, distance))
    return out.distinct()


def chained(fps: DataFrame, distance: int) -> DataFrame:
    """a, b: links along shared values of whole-fingerprint balls; linear in the fingerprints at any density."""
    bits = [1 << i for i in range(64)]
    masks = [sum(some) for r in range(distance // 2 + 1) for some in combinations(bits, r)]
    balls = fps.select("fp", F.explode(F.transform(longs(masks), lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    least = balls.groupBy("value").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return balls.join(least, "value").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat an id or a text each give a row. A row without an id belongs
    to its group, which is named by the smallest id there is (null if none).
    All words of a text of any length count; a bit set in exactly half is not.
    Columns besides doc_id and text are ignored; an empty table gives none.
    """
    marked = checkpoint(fingerprints(docs))
    # By number of rows: in bytes they are few, but each makes 65 keys.
    parts = max(partitions(docs.sparkSession), -(-marked.count() // FILED))
    fps = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")).repartition(parts, "fp"))
    found = components(links(fps.select("fp"), distance, bucket)).withColumnRenamed("node", "fp")
    rooted = fps.join(found, "fp", "left")
    linked_fps, single = rooted.where("component is not null"), rooted.where("component is null")
    # From a checkpoint, so that adaptive execution can split the join where a component holds a third of all.
    named = checkpoint(linked_fps.groupBy("component").agg(F.min("first_id").alias("component_id")))
    classes = linked_fps.join(named, "component").select("fp", "component_id").union(single.select("fp", "first_id"))
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
