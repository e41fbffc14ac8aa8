"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut. Pieces are dealt
over shards, and each shard is packed by decreasing length: a piece goes where
it leaves the least room. If it fits nowhere a bin is opened, and the permitted
lengths are weighed against one another: for each one it is worked out what the
pieces still waiting would fill it with, and the length that then costs least a
word is opened. Finally each bin shrinks to the smallest permitted length that
holds its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint

CAPACITIES = (512, 1024, 2048, 4096)

#: Cost of a sequence of length c: c for its words, a fixed part, and attention's c * c over this span.
FIXED_COST, ATTENTION_SPAN = 32, 16_384

#: Pieces that a shard holds on average.
SHARD_PIECES = 20_000


def cost(capacity: int) -> float:
    return capacity + FIXED_COST + capacity * capacity / ATTENTION_SPAN


def filling(capacity: int, first: int, waiting: list[int], some: int) -> int:
    """Words that a bin opened for a piece would hold: after it, ever the longest waiting piece that fits.

    ``waiting`` counts the pieces by length; bit n of ``some`` tells that there are any of n words.
    """
    room = capacity - first
    while fits := some & ((2 << room) - 1):
        n = fits.bit_length() - 1
        room -= n * min(waiting[n], room // n)
        some = fits ^ (1 << n)
    return capacity - room


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each length (given in decreasing order), each bin's capacity when opened and in the end.

    Of permitted lengths that cost as much a word the shortest is opened.
    """
    capacities = tuple(sorted(capacities))
    rooms: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by room left
    some = 0  # bit r: rooms[r] has a bin
    waiting = [0] * (capacities[-1] + 1)
    for n in lengths:
        waiting[n] += 1
    wait = sum(1 << n for n in range(1, len(waiting)) if waiting[n])
    bins, offsets, opened, filled = [], [], [], []
    for n in lengths:
        waiting[n] -= 1
        if n and not waiting[n]:
            wait ^= 1 << n
        if fits := some >> n:
            room = n + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / max(1, filling(c, n, waiting, wait)), c))
            k = len(filled)
            opened.append(room)
            filled.append(0)
        bins.append(k)
        offsets.append(filled[k])
        filled[k] += n
        rooms[room - n].append(k)
        some |= 1 << (room - n)
    return bins, offsets, opened, [next(c for c in capacities if c >= f) for f in filled]


def pieces(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, part, start_word, n_words: each document's words, cut where they exceed ``most``; without words, one empty part."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"int((words - 1) div {most})")))
    cut = counted.select("doc_id", "words", F.explode(parts).alias("part")).withColumn("start_word", F.col("part").cast("long") * most)
    return cut.select("doc_id", "part", "start_word", F.least(F.lit(most), F.col("words") - F.col("start_word")).cast("int").alias("n_words"))


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, part, start_word, n_words, bin_id, bin_size, bin_offset of every piece of every document.

    Null and empty texts give one piece of no words, which takes no room. Ties
    in length go by doc_id, part and place in the input; rows that repeat an id
    are packed on their own. An empty table gives no pieces; other columns are
    ignored. Bins hold pieces of one shard only.
    """
    cut = checkpoint(pieces(docs, max(capacities)))
    shards = max(1, -(-cut.count() // shard_pieces))
    row = F.monotonically_increasing_id()  # of the checkpoint, so the same when a task is run again
    dealt = cut.withColumn("row", row).withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "row"), F.lit(shards)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_words", "doc_id", "part", "row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, _, sizes = pack(group["n_words"].tolist(), capacities)
        group["bin_id"] = group["shard"] * (1 << 32) + np.array(bins, np.int64)
        group["bin_size"] = np.array(sizes, np.int32)[bins]
        group["bin_offset"] = np.array(offsets, np.int32)
        return group[["doc_id", "part", "start_word", "n_words", "bin_id", "bin_size", "bin_offset"]]

    return dealt.groupBy("shard").applyInPandas(packed, "doc_id long, part int, start_word long, n_words int, bin_id long, bin_size int, bin_offset int")
