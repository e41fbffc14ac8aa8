"""Periodic runs of words: stretches that repeat one period three times or more.

A run of period p and length L has L - p places whose word equals the one p
places on. As L is at least ``max(24, 3p)``, these places hold at least one
multiple of ``max(24 - p, 2p)``. Such multiples are the grid of p; the grids of
all periods of a document of n words have O(n log n) points together.

1. Grid. Of all (period, grid point) pairs, those whose two words differ go.
2. Extension. Prefix hashes (mod 2**64) compare any two stretches in constant
   time. A binary search finds the longest common extension to the right and to
   the left, in one loop of NumPy steps for all pairs of a slice at once.
3. Verification. Each stretch's words are compared themselves, and its
   neighbours; a period for which a hash was wrong is worked out word by word.
4. Deduplication. Pairs of one run find the same stretch, as do the multiples
   of its period; the smallest period stands for it.

A document is worked on by itself, so nothing is shuffled, and a lost task is
simply run again. Pairs are handled in slices of a bounded number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BASE_A, doc_text, mixed, starts_of, text_chunks

#: Least words of a run, and least repetitions of its period.
LEAST, TIMES = 24, 3

#: (Period, grid point) pairs that are looked at together.
PAIRS = 1 << 19

RUNS = "array<struct<start: long, length: long, period: long>>"


def prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base, and the sums of words times powers before each place."""
    powers = np.full(len(ids) + 1, BASE_A, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(BASE_A)) * powers[:-1], out=sums[1:])
    return powers, sums


def _longest(equal, most: np.ndarray) -> np.ndarray:
    """The largest m up to ``most`` for which ``equal(m)`` holds, for all pairs at once; it holds for 0 and for all m below."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = equal(mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def grid(n: int, least: int = LEAST, times: int = TIMES, pairs: int = PAIRS):
    """Arrays of periods and grid points of a document of n words, about ``pairs`` at a time."""
    periods = np.arange(1, n // times + 1)
    steps = np.maximum(least - periods, (times - 1) * periods)
    counts = -(-(n - periods) // steps)
    slices = (np.cumsum(counts) - 1) // pairs
    for k in np.split(np.arange(len(periods)), np.nonzero(np.diff(slices))[0] + 1):
        p = np.repeat(periods[k], counts[k])
        yield p, (np.arange(len(p)) - np.repeat(starts_of(counts[k]), counts[k])) * np.repeat(steps[k], counts[k])


def word_by_word(ids: np.ndarray, p: int) -> list[tuple[int, int]]:
    """Start and end of each stretch of period p, from its words alone."""
    change = np.flatnonzero(np.diff(np.concatenate(([0], (ids[:-p] == ids[p:]).view(np.int8), [0]))))
    return [(s, e + p) for s, e in change.reshape(-1, 2).tolist()]


def verified(ids: np.ndarray, start: int, end: int, p: int) -> bool:
    """Whether the stretch has the period and neither neighbour goes on with it."""
    return (
        bool((ids[start : end - p] == ids[start + p : end]).all())
        and (start == 0 or ids[start - 1] != ids[start - 1 + p])
        and (end == len(ids) or ids[end] != ids[end - p])
    )


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES, pairs: int = PAIRS, hashes=prefix_hashes) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start and period, of a document given as word numbers."""
    n, found = len(ids), {}
    if n < max(least, times):
        return []
    powers, sums = hashes(ids)
    for p, at in grid(n, least, times, pairs):
        hit = ids[at] == ids[at + p]
        p, at = p[hit], at[hit]

        def right(m, p=p, at=at):
            return (sums[at + m] - sums[at]) * powers[p] == sums[at + p + m] - sums[at + p]

        def left(m, p=p, at=at):
            return (sums[at] - sums[at - m]) * powers[p] == sums[at + p] - sums[at + p - m]

        start = at - _longest(left, at)
        end = at + p + _longest(right, n - p - at)
        long = end - start >= np.maximum(least, times * p)
        wrong = set()
        for q, s, e in np.unique(np.stack([p[long], start[long], end[long]]), axis=1).T.tolist():
            if (found.get((s, e), q) == q or q % found[s, e]) and not verified(ids, s, e, q):
                wrong.add(q)
            else:
                found.setdefault((s, e), q)
        for q in sorted(wrong):  # found so far with this period is not to be trusted
            found = {k: v for k, v in found.items() if v != q}
            for s, e in word_by_word(ids, q):
                if e - s >= max(least, times * q):
                    found[s, e] = min(q, found.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what runs repeat after their first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of every row of ``docs``.

    Words are stretches without ASCII blanks. Null and empty texts have no words
    and no runs; ids may be null or repeat, and each row is worked on by itself.
    Of texts of any length all words count. A stretch that has several periods
    counts once, by the smallest; runs with one start are listed by period. An
    empty table gives none; other columns are ignored.
    """

    def of(batches):
        for batch, texts in text_chunks(batches):
            numbers: dict[bytes, int] = {}
            n, runs, rest = [], [], []
            for text in texts:
                words = text.split()
                found = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), least, times)
                n.append(len(words))
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
                rest.append(collapsed(words, found).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(rest, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return doc_text(docs).mapInArrow(of, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth document (by its id's hash) with the tail that its query's contract lays down: from word a on, a stretch of p words over and over. Rows without an id keep their text."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = doc_text(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN cast(g % n AS int) END"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p AS int))), 1, n - a)"
    return rows.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN array_join(concat(slice(w, 1, a), {tail}), ' ') ELSE text END").alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row for each row of ``periodic_runs``: its number of runs, the run of most repetitions, and digests of all runs and of the collapsed text."""
    more = "a.length * b.period - b.length * a.period"
    order = f"CASE WHEN {more} <> 0 THEN cast(sign(b.length * a.period - a.length * b.period) AS int) WHEN a.start <> b.start THEN cast(sign(a.start - b.start) AS int) ELSE cast(sign(a.period - b.period) AS int) END"
    rows = found.withColumn("best", F.expr(f"get(array_sort(runs, (a, b) -> {order}), 0)"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
