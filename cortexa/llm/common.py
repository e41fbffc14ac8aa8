"""Helpers that the corpus operators share: Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import checkpoint, stored  # noqa: F401  for the operators

#: Text bytes that one step of a Python task holds as words at a time (a longer text goes alone).
CHUNK_BYTES = 2 << 20

#: Ids up to which the ids of rows to drop are broadcast (some 40 MB in each executor).
BROADCAST_IDS = 1_000_000

#: Odd multipliers of the two rolling polynomial hashes over word hashes.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with the UTF-8 bytes of their texts (null: empty), about ``limit`` bytes each."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        start = held = 0
        for i, text in enumerate(texts):
            if held and held + len(text) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(text) + 64
        if start < len(texts):
            yield batch.slice(start), texts[start:]


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each run of ``size`` values; len(values) - size + 1 of them."""
    out, done, power = values[: max(0, len(values) - size + 1)] * np.uint64(0), 0, base
    block, width = values, 1
    while True:
        if size & width:
            keep = len(values) - size + 1
            if keep <= 0:
                return out
            out = out * np.uint64(power) + block[done : done + keep]
            done += width
        width *= 2
        if width > size:
            return out
        block = block[: len(block) - width // 2] * np.uint64(power) + block[width // 2 :]
        power = power * power % 2**64


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def doc_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (with further columns) alone, whatever else the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def without(docs: DataFrame, gone: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is not among those of ``gone``; rows without one stay.

    Few ids are broadcast, which leaves the texts where they are; more are
    joined.
    """
    gone = stored(gone.select("doc_id").where("doc_id is not null").distinct())
    gone = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

#: Bytes outside words (ASCII but for digits and letters) become blanks, and A-Z become a-z.
WORD_BYTES = bytes(x if x >= 0x80 else x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(WORD_BYTES).split()


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of the given lengths starts."""
    return np.cumsum(counts) - counts


def commonest(counts: DataFrame, groups: list[str], most: int) -> tuple[list, dict]:
    """The rows of each group with the largest ``n``, at most ``most`` of them, and each group's sum of ``n``.

    Rows are chosen by a limit on n, found from a histogram in steps of an
    eighth of a power of two, so no group is sorted in one place; of counts
    that straddle the bound none is taken.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(*groups, step.alias("step")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    totals: dict = {}
    limits: dict = {}
    taken: dict = {}
    for r in sorted(steps, key=lambda r: -r["step"]):
        key = tuple(r[g] for g in groups)
        totals[key] = totals.get(key, 0) + r["n"]
        taken[key] = taken.get(key, 0) + r["rows"]
        if taken[key] <= most:
            limits[key] = r["step"]
    if not limits:
        return [], totals
    chosen = counts.sparkSession.createDataFrame([(*k, v) for k, v in limits.items()], [*groups, "least"]) if groups else None
    if chosen is None:
        return counts.where(step >= limits[()]).collect(), totals
    return counts.join(F.broadcast(chosen), groups).where(step >= F.col("least")).drop("least").collect(), totals


def most_common(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest ``n``, at most ``most`` of them and none of counts that straddle the bound: what tasks may hold."""
    step = F.floor(F.log2("n") * 8).cast("int")
    taken, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        taken += r["count"]
        if taken > most:
            break
        least = r["step"]
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)
