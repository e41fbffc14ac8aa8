"""Language-model scoring with Brown's class-based bigrams.

Exchange clustering moves the commonest words, and the rarer ones by groups of
like shape, between classes as long as the likelihood of the training text
grows. Then each rarer word takes the class with the largest exchange gain, all
judged on the classes that the first step found. A word has the probability of
its class after the class before it, times that of the word in its class:

    P(w | v) = P(class(w) | class(v)) * (count(w) + 1) / (tokens + types + 1 of class(w))

Word counts, class transitions and emissions are taken over all training text.
The first step's vocabulary and the words that every task holds have bounds; all
other words meet their classes and counts in a join. A word that is not in the
training text has the class of its shape.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import doc_text, most_common, starts_of, stored, text_chunks

FOLDS, FOLD = 7, 2

#: Words that are clustered one by one, their classes, and words whose counts every task holds.
CLUSTERED, CLASSES, HELD_WORDS = 1_000, 48, 150_000

#: Sweeps of the exchange after which it is an error that words still move; each move makes the likelihood larger, so it does end.
SWEEPS_AT_MOST = 1_000

#: Added to each count of a class after another.
SMOOTH = 0.1

#: Counts that a task holds before it passes them on, and items of lists that one step of it works on.
HELD, STEP = 500_000, 400_000

#: Neighbours whose words are given classes in one step; each word has some rows of as many numbers as there are classes.
CLASS_STEP = 30_000

SHAPES = 24


def shape(word: bytes) -> int:
    """Group of a rarer word: by its length, its last character, and whether it has digits or characters above ASCII."""
    size = 0 if len(word) <= 6 else 1 if len(word) <= 12 else 2
    if word.isalpha():  # ASCII letters alone
        return size * 8
    return ((size * 2 + (len(word.translate(None, b"0123456789")) < len(word))) * 2 + (not word.isascii())) * 2 + (word[-1] < 48 or 58 <= word[-1] <= 64)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == FOLD, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Model(NamedTuple):
    """What every task holds. Items are the held words, then the shapes; the last class is the end's."""

    words: dict[bytes, int]
    log_counts: np.ndarray  # log10(count + 1) of the held words
    known: np.ndarray  # class of each item
    log_moves: np.ndarray  # log10 of the probability of a class after another
    log_sizes: np.ndarray  # log10(tokens + types + 1) of each class; 0 of the end's
    tokens: int
    types: int
    ends: int


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts."""

    def of(batches):
        counts: Counter = Counter()

        def passed():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for _, texts in text_chunks(batches):
            for text in texts:
                counts.update(words_of(text))
            if len(counts) > HELD:
                yield passed()
        yield passed()

    return doc_text(docs).mapInArrow(of, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Items(dict):
    """Number of a word: its own, or after all of them that of its shape."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__(words)
        self.own = len(words)
        self.extra = 0

    def __missing__(self, word: bytes) -> int:
        item = self.own + shape(word)
        if self.extra < 300_000:
            self[word] = item
            self.extra += 1
        return item


class Numbers(dict):
    """Numbers of words: the given ones, then those in ``names`` as they come; ``kinds`` has a kind for each, shapes for new ones."""

    def __init__(self, words: dict[bytes, int], kinds: np.ndarray, shapes: np.ndarray):
        super().__init__(words)
        self.names: list[bytes] = []
        self.kinds, self.shapes, self.own = kinds, shapes, len(words)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.names.append(word)
        return n

    def line(self, texts: list[bytes], ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, with -1 before the first and behind each if ``ends``; and the texts' numbers of words."""
        line, size = [-1] if ends else [], []
        for text in texts:
            before = len(line)
            line += map(self.__getitem__, words_of(text))
            size.append(len(line) - before)
            if ends:
                line.append(-1)
        new = self.names[len(self.kinds) - self.own :]
        self.kinds = np.append(self.kinds, self.shapes[np.fromiter(map(shape, new), np.int64, len(new))])
        return np.array(line, np.int64), np.array(size, np.int64)


def list_slices(batch: pa.RecordBatch, column: int, step: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists in ``column`` have at most ``step`` items, ``STEP`` if none is given (a longer list goes alone)."""
    step = step or STEP
    ends = np.append(0, np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy().astype(np.int64) + 1))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + step, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def bigrams(docs: DataFrame, words: dict[bytes, int]) -> np.ndarray:
    """Counts of item after item over all texts; each text starts and ends with the last item."""
    size = len(words) + SHAPES + 1
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def of(batches):
        items, total = Items(shared.value), np.zeros(size * size, np.int64)
        held, many = [], 0
        for _, texts in text_chunks(batches):
            line = [size - 1]
            for text in texts:
                line += map(items.__getitem__, words_of(text))
                line.append(size - 1)
            line = np.array(line, np.int64)
            held.append((line[:-1] * size + line[1:]).astype(np.int32))
            many += len(line)
            if many > STEP:
                total += np.bincount(np.concatenate(held), minlength=size * size)
                held, many = [], 0
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int32)]), minlength=size * size)
        pair = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    rows = doc_text(docs).mapInArrow(of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each item from their bigram counts, when no item gains by moving alone; the last item (the end) alone has the last class.

    Items move in the order of their counts, equal ones in their own order, to
    the class of the largest gain, of equal gains the first. A gain must be above
    the rounding errors of the likelihood's terms, a trillionth of the largest.
    """
    least = 1e-12 * max(1.0, float(_xlogx(counts.sum())))
    m = len(counts) - 1
    order = np.argsort(-counts[:m].sum(axis=1), kind="stable")
    own = np.empty(m + 1, np.int64)
    own[order] = np.arange(m) % classes
    own[m] = classes
    after = np.zeros((m + 1, classes + 1))  # counts of each item followed by each class
    before = np.zeros((m + 1, classes + 1))
    for c in range(classes + 1):
        after[:, c] = counts[:, own == c].sum(axis=1)
        before[:, c] = counts[own == c].sum(axis=0)
    table = np.array([after[own == c].sum(axis=0) for c in range(classes + 1)])
    for _ in range(SWEEPS_AT_MOST):
        moved = 0
        for w in order.tolist():
            a, r, c, s = own[w], after[w].copy(), before[w].copy(), counts[w, w]
            if not r.sum() + c.sum():
                continue
            r[a] -= s
            c[a] -= s
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= s
            # How often the classes stand first and second, the item's neighbours among them, whatever its own class is.
            left, right = table.sum(axis=1) + c, table.sum(axis=0) + r
            gain_r = _xlogx(table + r) - _xlogx(table)
            gain_c = _xlogx(table + c[:, None]) - _xlogx(table)
            diagonal = np.diagonal(table)
            gain = gain_r.sum(axis=1) + gain_c.sum(axis=0) - np.diagonal(gain_r) - np.diagonal(gain_c)
            gain += _xlogx(diagonal + r + c + s) - _xlogx(diagonal)
            gain -= _xlogx(left + r.sum() + s) - _xlogx(left) + _xlogx(right + c.sum() + s) - _xlogx(right)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + least:
                b = a
            table[b] += r
            table[:, b] += c
            table[b, b] += s
            if b != a:
                moved += 1
                own[w] = b
                after[:, a] -= counts[:, w]
                after[:, b] += counts[:, w]
                before[:, a] -= counts[w]
                before[:, b] += counts[w]
        if not moved:
            return own
    raise RuntimeError(f"words still move after {SWEEPS_AT_MOST} sweeps")


def neighbour_counts(docs: DataFrame, words: dict[bytes, int], found: np.ndarray) -> DataFrame:
    """word, keys, counts: how often each word without a number of its own stands before (key c), and after (key K + c), class c of K, and (key 2 K) next to itself.

    A word has a row for each task that saw it, one behind the other in one partition.
    """
    k = int(found[-1]) + 1
    shared = docs.sparkSession.sparkContext.broadcast((words, found))

    def of(batches):
        own, classes = shared.value
        end = int(classes[-1])
        kinds, shapes = classes[: len(own)], classes[len(own) : len(own) + SHAPES]
        numbers = Numbers(own, kinds, shapes)
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merged():
            keys, n = np.concatenate(held), np.concatenate(counts)
            held.clear()
            counts.clear()
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else order
            held.append(keys[first])
            counts.append(np.add.reduceat(n, first) if len(keys) else n)
            return held[0], counts[0]

        def passed():
            nonlocal numbers
            keys, n = merged()
            word = keys // (2 * k + 1)
            first = np.nonzero(np.append(-1, word[:-1]) != word)[0] if len(word) else word
            ends = pa.array(np.append(first, len(keys)).astype(np.int32))
            column = pa.array(numbers.names, pa.binary()).take(pa.array(word[first]))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((keys % (2 * k + 1)).astype(np.int16), n.astype(np.int32))]
            out = pa.RecordBatch.from_arrays([column, *lists], ["word", "keys", "counts"])
            numbers = Numbers(own, kinds, shapes)
            held.clear()
            counts.clear()
            return out

        for _, texts in text_chunks(batches):
            line, _ = numbers.line(texts, ends=True)
            near, ids = np.append(numbers.kinds, end)[line], np.where(line < len(own), -1, line - len(own))
            same = (ids[:-1] == ids[1:]) & (ids[1:] >= 0)
            before, after = ids[:-1] >= 0, (ids[1:] >= 0) & ~same
            keys = np.concatenate([ids[:-1][before] * (2 * k + 1) + np.where(same, 2 * k, near[1:])[before], ids[1:][after] * (2 * k + 1) + k + near[:-1][after]])
            keys, n = np.unique(keys, return_counts=True)
            held.append(keys)
            counts.append(n.astype(np.int32))
            if len(numbers.names) > HELD // 2 or sum(map(len, held)) > 2 * HELD and len(merged()[0]) > HELD:
                yield passed()
        if held:
            yield passed()

    # A row for each word of a task goes through the shuffle; its rows are summed as they are read in order.
    return doc_text(docs).mapInArrow(of, "word binary, keys array<short>, counts array<int>").repartition("word").sortWithinPartitions("word")


def whole_words(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Words, and the number of each one's word, key and count, from batches of word, keys (under ``wide``), counts in order of words, which may repeat."""
    name, keys, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in (part for whole in batches for part in list_slices(whole, 1, CLASS_STEP)):
        names = batch.column(0)
        new = np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))
        found, word = names.filter(pa.array(new)).to_pylist(), np.cumsum(new) - 1
        if name is not None and name != found[0]:
            found.insert(0, name)
            word += 1
        pair = np.append(keys, np.repeat(word, batch.column(1).value_lengths().to_numpy()) * wide + batch.column(1).flatten().to_numpy())
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.nonzero(np.append(True, pair[1:] != pair[:-1]))[0]
        n = np.add.reduceat(np.append(counts, batch.column(2).flatten().to_numpy())[order], first)
        word, key = pair[first] // wide, pair[first] % wide
        last = int(np.searchsorted(word, len(found) - 1))
        name, keys, counts = found[-1], key[last:], n[last:]  # more of it may come
        if last:
            yield found[:-1], word[:last], key[:last], n[:last]
    if name is not None:
        yield [name], np.zeros(len(keys), np.int64), keys, counts


def _added(base: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What counts ``x`` add to the sum of n log n over ``base``."""
    return _xlogx(base + x) - _xlogx(base)


def best_classes(table: np.ndarray, own: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each word with the largest exchange gain, one by one on the same ``table`` of class after class, which has it in ``own``.

    Most words have few neighbours and small counts, so what a count adds to
    each class is worked out once for each count and neighbours' class.
    """
    k, many = len(table), len(own)
    n = n.astype(float)
    rows = np.arange(many)
    after, before, s = np.zeros((many, k)), np.zeros((many, k)), np.zeros(many)
    is_after, is_before = key < k, (key >= k) & (key < 2 * k)
    after[word[is_after], key[is_after]] = n[is_after]
    before[word[is_before], key[is_before] - k] = n[is_before]
    s[word[key == 2 * k]] = n[key == 2 * k]
    gain = np.zeros((many, k))
    for side, whole, other in ((is_after, table.T, before), (is_before, table, after)):
        w, c, x = word[side], key[side].astype(np.int64) % k, n[side]
        mine = c == own[w]  # neighbours in the word's own class, whose counts have the word's other side in them
        v = w[mine]
        grown = _added(whole[own[v]] - other[v], x[mine][:, None])
        grown[np.arange(len(v)), own[v]] = 0  # within a class: below
        gain[v] += grown
        w, c, x = w[~mine], c[~mine], x[~mine]
        kinds, kind = np.unique(x * k + c, return_inverse=True)
        sizes, at = kinds // k, (kinds % k).astype(np.int64)
        grown = _added(whole[at], sizes[:, None])
        grown[np.arange(len(at)), at] = 0
        for b in range(k):
            gain[:, b] += np.bincount(w, grown[kind, b], many)
        present = whole[c, own[w]]  # the own class has the counts already
        gain[rows, own] += np.bincount(w, _added(present - x, x) - grown[kind, own[w]], many)
    inside = after + before + s[:, None]
    w, b = np.nonzero(inside)
    x = inside[w, b]
    gain[w, b] += _added(np.diagonal(table)[b] - np.where(b == own[w], x, 0), x)
    for own_side, sums in ((after, table.sum(axis=1)), (before, table.sum(axis=0))):
        total = own_side.sum(axis=1) + s
        sizes, kind = np.unique(total, return_inverse=True)
        grown = _added(sums, sizes[:, None])
        gain -= grown[kind]
        gain[rows, own] -= _added(sums[own] - total, total) - grown[kind, own]
    best = gain[:, : k - 1].argmax(axis=1)
    return np.where(gain[rows, best] > gain[rows, own] + 1e-9, best, own)


def classed_words(docs: DataFrame, clustered: int, classes: int) -> tuple[DataFrame, np.ndarray]:
    """word, n, class of every word of ``docs``, and the class of each shape."""
    top = word_counts(docs).orderBy(F.desc("n"), "word").limit(clustered).collect()
    own = {bytes(r["word"]): i for i, r in enumerate(top)}
    pairs = bigrams(docs, own)
    found = exchange(pairs, classes)
    member = np.eye(classes + 1)[found]
    table, shapes = member.T @ pairs @ member, found[len(own) : len(own) + SHAPES]

    def of(batches):
        for words, word, key, n in whole_words(batches, 2 * (classes + 1) + 1):
            mine = np.array([shapes[shape(w)] for w in words], np.int64)
            best = best_classes(table, mine, word, key, n)
            follows = (key <= classes) | (key == 2 * (classes + 1))  # each word is followed by something once
            total = np.bincount(word[follows], n[follows], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(total), pa.array(best.astype(np.int32))], ["word", "n", "class"])

    rest = stored(neighbour_counts(docs, own, found).mapInArrow(of, "word binary, n long, class int"))
    first = docs.sparkSession.createDataFrame([(bytearray(r["word"]), r["n"], int(found[i])) for i, r in enumerate(top)], "word binary, n long, class int")
    return rest.union(first), shapes


def kinds_of(docs: DataFrame, classed: DataFrame, shapes: np.ndarray, classes: int, held_words: int) -> tuple[DataFrame, dict[bytes, int], np.ndarray, np.ndarray]:
    """doc_id, held_out, kinds (classes of a text's words), n_known, log_counts of every row; the held words, log counts and classes."""
    held = most_common(classed, held_words).toArrow()
    words = {w: i for i, w in enumerate(held["word"].to_pylist())}
    log_counts = np.log10(held["n"].to_numpy().astype(float) + 1)
    known = np.concatenate([held["class"].to_numpy().astype(np.int64), shapes])
    shared = docs.sparkSession.sparkContext.broadcast((words, log_counts, known))

    def of(batches):
        words, log_counts, known = shared.value
        own = len(words)
        numbers = Numbers(words, known[:own], known[own:])
        for batch, texts in text_chunks(batches):
            if len(numbers.names) > HELD // 2:
                numbers = Numbers(words, known[:own], known[own:])
            line, size = numbers.line(texts, ends=False)
            ends = np.append(0, np.cumsum(size))
            is_held = line < own
            doc = np.repeat(np.arange(len(size)), size)
            log_held = np.bincount(doc[is_held], log_counts[line[is_held]], len(size)).astype(float)
            # The other words of each text, each with all its places there.
            at = np.nonzero(~is_held)[0]
            key = doc[at] * len(numbers) + line[at]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else order
            stops = np.append(0, np.cumsum(np.bincount(doc[at[first]], minlength=len(size))))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at - ends[doc[at]], pa.int32()))
            pairs = pa.StructArray.from_arrays([pa.array([numbers.names[w - own] for w in line[at[first]].tolist()], pa.binary()), places], ["word", "at"])
            kinds = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers.kinds[line].astype(np.int16)))
            rest = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), kinds, pa.array(np.bincount(doc[is_held], minlength=len(size))), pa.array(log_held), rest], ["doc_id", "held_out", "kinds", "n_held", "log_held", "rest"])

    rows = doc_text(docs, held_out().alias("held_out")).mapInArrow(of, "doc_id long, held_out boolean, kinds array<short>, n_held long, log_held double, rest array<struct<word:binary,at:array<int>>>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", F.inline("rest")).join(classed, "word")
    met = met.groupBy("row").agg(F.collect_list(F.struct("at", "class")).alias("met"), F.sum(F.size("at") * F.log10(F.col("n") + 1)).alias("log_rest"), F.sum(F.size("at")).alias("n_rest"))
    whole = rows.drop("rest").join(met, "row", "left").fillna(0, ["log_rest", "n_rest"])
    whole = whole.select("doc_id", "held_out", "kinds", (F.col("n_held") + F.col("n_rest")).alias("n_known"), (F.col("log_held") + F.col("log_rest")).alias("log_counts"), "met")

    def filled(batches):
        for batch in (part for whole in batches for part in list_slices(whole, 2)):
            lists, met = batch.column(2), batch.column(5)
            kinds = lists.flatten().to_numpy().copy()
            size = lists.value_lengths().to_numpy()
            ends, first = np.append(0, np.cumsum(size)), starts_of(size)
            many = met.value_lengths().fill_null(0).to_numpy()
            inner = met.flatten()
            at, kind = inner.field("at"), inner.field("class").to_numpy()
            length = at.value_lengths().to_numpy()
            doc = np.repeat(np.repeat(np.arange(len(size)), many), length)
            kinds[first[doc] + at.flatten().to_numpy()] = np.repeat(kind, length)
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kinds, pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out, batch.column(3), batch.column(4)], ["doc_id", "held_out", "kinds", "n_known", "log_counts"])

    out = stored(whole.mapInArrow(filled, "doc_id long, held_out boolean, kinds array<short>, n_known long, log_counts double"))
    return out, words, log_counts, known


def _line(kinds: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts, each text with an end after it, and the texts' lengths with it."""
    n = kinds.value_lengths().to_numpy().astype(np.int64) + 1
    line = np.full(n.sum(), end, np.int64)
    inside = np.ones(len(line), bool)
    inside[np.cumsum(n) - 1] = False
    line[inside] = kinds.flatten().to_numpy()
    return line, n


def transitions(kinds: DataFrame, classes: int) -> np.ndarray:
    """Counts of class after class over all rows; each text starts and ends with the last one."""
    k = classes + 1

    def of(batches):
        total = np.zeros(k * k, np.int64)
        for batch in (part for whole in batches for part in list_slices(whole, 0)):
            line, _ = _line(batch.column(0), classes)
            total += np.bincount(np.append(classes, line[:-1]) * k + line, minlength=k * k) if len(line) else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], ["pair", "n"])

    rows = kinds.select("kinds").mapInArrow(of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(k, k)


def _model(classed: DataFrame, table: np.ndarray, words: dict[bytes, int], log_counts: np.ndarray, known: np.ndarray) -> Model:
    k = len(table)
    moves = (table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * k)
    types, tokens = np.zeros(k), np.zeros(k)
    for r in classed.groupBy("class").agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect():
        types[r["class"]], tokens[r["class"]] = r["types"], r["n"]
    sizes = np.log10(tokens + types + 1)
    sizes[k - 1] = 0
    ends = int(table[:, k - 1].sum())
    return Model(words, log_counts, known, np.log10(moves), sizes, int(tokens.sum()) + ends, int(types.sum()) + (ends > 0), ends)


def train(docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, held_words: int = HELD_WORDS) -> tuple[Model, DataFrame]:
    """The model, and word, n, class of all words, from the rows of ``docs``."""
    classed, shapes = classed_words(docs, clustered, classes)
    kinds, *held = kinds_of(docs, classed, shapes, classes, held_words)
    return _model(classed, transitions(kinds, classes), *held), classed


def lm_scores(docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, held_words: int = HELD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs``.

    Rows of the training fold are learned from. Null texts count as empty: an
    end alone. Rows that repeat an id are scored on their own; a row without an
    id is learned from. Without any training row each token has base
    probability 1. Other columns are ignored; an empty table gives none.
    """
    classed, shapes = classed_words(docs.where(~held_out()), clustered, classes)
    kinds, *held = kinds_of(docs, classed, shapes, classes, held_words)
    model = _model(classed, transitions(kinds.where(~F.col("held_out")), classes), *held)
    moves, sizes = model.log_moves, model.log_sizes

    def of(batches):
        for batch in (part for whole in batches for part in list_slices(whole, 2)):
            line, n = _line(batch.column(2), classes)
            previous = np.append(classes, line[:-1])
            model_sum = np.add.reduceat(moves[previous, line] - sizes[line], starts_of(n)) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(n), pa.array(model_sum)], ["doc_id", "held_out", "n_known", "log_counts", "n_tokens", "model_sum"])

    whole = kinds.mapInArrow(of, "doc_id long, held_out boolean, n_known long, log_counts double, n_tokens long, model_sum double")
    ends, total = model.ends, float(np.log10(model.tokens + model.types + 1))
    score = F.col("model_sum") + F.col("log_counts")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
