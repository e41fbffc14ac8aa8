"""Language identification with word-first backoff.

A word that is known scores by its log frequency in each language. One that is
not scores by its characters: at each of its positions by the longest known
n-gram, from four letters down to one, averaged over the word. All words and
n-grams of the training fold are known. Tasks hold the commonest; all others
meet their scores in joins, so what is held bears on time alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_text, most_common, starts_of, stored, text_chunks

FOLDS, FOLD = 3, 1
GRAM = 4

#: Words and n-grams whose scores every task holds; fewer where the scores of so many languages would exceed CELLS.
WORDS, GRAMS, CELLS = 150_000, 150_000, 4_000_000
#: Counts that a task holds before it passes them on.
HELD = 400_000

WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == FOLD, F.lit(False))


def words_of(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def grams_of(word: str, size: int) -> list[str]:
    line = f" {word} "
    return [line[i : i + size] for i in range(len(line) - size + 1)]


def _passed(counts: dict[int, Counter]) -> pa.RecordBatch:
    langs = np.repeat(np.array(list(counts), np.int32), [len(c) for c in counts.values()])
    words = pa.array([w for c in counts.values() for w in c], pa.string())
    n = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
    counts.clear()
    return pa.RecordBatch.from_arrays([pa.array(langs), words, n], ["lang", "word", "n"])


def _gathered(rows: DataFrame) -> DataFrame:
    """word, n (over all documents), seen (lang and n of each language of the training fold) from partial counts."""
    counts = rows.repartition("word").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("lang") >= 0, F.struct("lang", "n"))).alias("seen"))


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """word, n, seen over all documents; languages by their places, -1 for what is not learned from."""
    place = {x: i for i, x in enumerate(langs)}

    def of(batches):
        counts: dict[int, Counter] = defaultdict(Counter)
        for batch, texts in text_chunks(batches):
            for lang, text in zip(batch.column(2).to_pylist(), texts, strict=True):
                counts[place.get(lang, -1)].update(words_of(text))
            if sum(map(len, counts.values())) > HELD:
                yield _passed(counts)
        yield _passed(counts)

    rows = doc_text(docs, F.when(~held_out(), F.col("lang").cast("string")).alias("lang"))
    return _gathered(rows.mapInArrow(of, "lang int, word string, n long"))


def gram_counts(vocabulary: DataFrame) -> DataFrame:
    """word (the n-gram), n, seen of the n-grams of the words that were seen in training."""

    def of(batches):
        counts: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for word, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = [g for size in range(1, GRAM + 1) for g in grams_of(word, size)]
                for s in seen:
                    held, n = counts[s["lang"]], s["n"]
                    for gram in grams:
                        held[gram] += n
            if sum(map(len, counts.values())) > HELD:
                yield _passed(counts)
        yield _passed(counts)

    return _gathered(vocabulary.where(F.size("seen") > 0).select("word", "seen").mapInArrow(of, "lang int, word string, n long"))


def _base(table: DataFrame, langs: int, sizes: int) -> tuple[np.ndarray, int]:
    """Log of the smoothed frequency of a term without counts in each language (a row each size), and the number of terms."""
    size = F.length("word") if sizes > 1 else F.lit(1)
    rows = table.where(F.size("seen") > 0).select(size.alias("size"), F.inline("seen")).groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()
    terms = table.where(F.size("seen") > 0).count()
    total = np.zeros((sizes, langs))
    for r in rows:
        total[r["size"] - 1, r["lang"]] = r["n"]
    return np.log(0.5 / (total + 0.5 * max(1, terms))), terms


def _added(seen: list[dict], langs: int) -> np.ndarray:
    """What counts add to the log frequency of a term without any."""
    out = np.zeros(langs)
    for s in seen:
        out[s["lang"]] = np.log(2 * s["n"] + 1)
    return out


def _held_grams(grams: DataFrame, base: np.ndarray, most: int) -> tuple[dict[str, int], np.ndarray]:
    held = most_common(grams, most).select("word", "seen").toArrow()
    names = held["word"].to_pylist()
    added = [_added(seen, base.shape[1]) + base[len(w) - 1] for w, seen in zip(names, held["seen"].to_pylist(), strict=True)]
    return {w: i for i, w in enumerate(names)}, np.array(added).reshape(len(names), base.shape[1])


def unseen_words(vocabulary: DataFrame, grams: DataFrame, langs: list[str], most: int) -> DataFrame:
    """word, n, scores of each word that was not seen in training, by the longest known n-gram at each position.

    Each word comes once. Where tasks cannot hold all n-grams, those that are
    not held and longer than the longest held one meet their counts in a join.
    """
    base, terms = _base(grams, len(langs), GRAM)
    names, held_scores = _held_grams(grams, base, most)
    whole = len(names) == terms
    shared = vocabulary.sparkSession.sparkContext.broadcast((names, held_scores))

    def of(batches):
        known, scores = shared.value
        scorer = Scorer(Model(langs, {}, np.empty((0, len(langs))), known, scores))
        for batch in batches:
            words = batch.column(0).to_pylist()
            places = [scorer.longest(w) for w in words]
            missing = [[] if whole else _missing(w, x, known) for w, x in zip(words, places, strict=True)]
            owner = np.repeat(np.arange(len(words)), [len(x) for x in places])
            flat = np.array([p for x in places for p in x], np.int64)
            owner, flat = owner[flat >= 0], flat[flat >= 0]
            out = np.array([np.bincount(owner, scores[flat, k], len(words)) for k in range(len(langs))]) / np.maximum(1, np.bincount(owner, minlength=len(words)))
            kinds = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out.T), pa.list_(pa.float64())), pa.array(missing, kinds)], ["word", "n", "scores", "missing"])

    unseen = vocabulary.where(F.size("seen") == 0).select("word", "n")
    first = stored(unseen.mapInArrow(of, "word string, n long, scores array<double>, missing array<struct<at:int,gram:string>>"))
    if whole:
        return first.drop("missing")
    asked = first.select("word", F.inline("missing"))
    met = asked.join(grams.select(F.col("word").alias("gram"), "seen"), "gram").groupBy("word").agg(F.collect_list(F.struct("at", "gram", "seen")).alias("met"))

    def again(batches):
        known, scores = shared.value
        scorer = Scorer(Model(langs, {}, np.empty((0, len(langs))), known, scores))
        for batch in batches:
            out = []
            for word, met in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = [(0 if p < 0 else 1, scores[p] if p >= 0 else 0) for p in scorer.longest(word)]
                for m in sorted(met, key=lambda m: len(m["gram"])):
                    best[m["at"]] = (1, _added(m["seen"], len(langs)) + base[len(m["gram"]) - 1])
                out.append(sum(x for _, x in best) / max(1, sum(k for k, _ in best)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["word", "n", "scores"])

    found = first.join(met, "word").select("word", "n", "met").mapInArrow(again, "word string, n long, scores array<double>")
    return stored(first.drop("missing").join(met.select("word"), "word", "left_anti").union(found))


def _missing(word: str, places: list[int], known: dict[str, int]) -> list[dict]:
    """The n-grams at each position that are longer than the longest held one."""
    line, out = f" {word} ", []
    for i in range(len(line)):
        for stop in range(min(i + GRAM, len(line)), i, -1):
            if line[i:stop] in known:
                break
            out.append({"at": i, "gram": line[i:stop]})
    return out


class Scorer(dict):
    """Place of a word among ``rows`` of per-language log frequencies, remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, []

    def __missing__(self, word: str) -> int:
        m = self.model
        row = m.words.get(word)
        self.rows.append(self.unknown(word) if row is None else m.word_scores[row])
        self[word] = place = len(self.rows) - 1
        return place

    def longest(self, word: str) -> list[int]:
        """At each position of a word the place of the longest held n-gram, -1 where there is none."""
        known, line = self.model.grams, f" {word} "
        found, end = [], len(line)
        for i in range(end):
            place = -1
            for stop in range(min(i + GRAM, end), i, -1):
                row = known.get(line[i:stop])
                if row is not None:
                    place = row
                    break
            found.append(place)
        return found

    def unknown(self, word: str) -> np.ndarray:
        found = [p for p in self.longest(word) if p >= 0]
        return self.model.gram_scores[found].sum(axis=0) / max(1, len(found))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
            self.rows = []
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        used, back = np.unique(places, return_inverse=True)
        return np.array([self.rows[i] for i in used.tolist()]).reshape(len(used), len(self.model.langs))[back]


def _letters(words: list[str]) -> list[str]:
    return words if any(c.isalpha() for w in words for c in w) else []


def language_id(docs: DataFrame, held_words: int = WORDS, held_grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, and so are
    all if no language was learned. Of languages with equal scores the first in
    order of name is taken; the score is the softmax of the summed scores over
    the root of the text's words. Rows without an id are trained on if they
    have a language, and are not held out. Rows that repeat an id or a text
    count and are scored each; all words of a text of any length count. An empty
    table gives none; other columns are ignored.
    """
    langs = sorted(r[0] for r in docs.where(~held_out()).select(F.col("lang").cast("string")).where("lang is not null").distinct().collect())
    if not langs:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    size = len(langs)
    vocabulary = stored(word_counts(docs, langs))
    grams = stored(gram_counts(vocabulary))
    base, _ = _base(vocabulary, size, 1)
    learned = [r[0] for r in vocabulary.select(F.explode("seen.lang")).distinct().sort("col").collect()]
    unseen = unseen_words(vocabulary, grams, langs, max(1, min(held_grams, CELLS // size)))
    # What a word adds to each language; -1: how often it was known, for what all known words have in common.
    seen = F.transform("seen", lambda s: F.struct(s["lang"].alias("lang"), F.log(2 * s["n"] + F.lit(1.0)).alias("x")))
    known = vocabulary.where(F.size("seen") > 0).select("word", "n", F.concat(seen, F.array(F.struct(F.lit(-1).alias("lang"), F.lit(1.0).alias("x")))).alias("adds"))
    scores = known.union(unseen.select("word", "n", F.transform("scores", lambda x, k: F.struct(k.alias("lang"), x.alias("x"))).alias("adds")))
    held = most_common(scores, max(1, min(held_words, CELLS // size))).select("word", "adds").toArrow()
    names = held["word"].to_pylist()
    adds = held["adds"].combine_chunks()
    table = np.zeros((size + 1, len(names) + 1))  # the last row: known; the last column: not held
    if len(names):
        owner = np.repeat(np.arange(len(names)), np.diff(adds.offsets.to_numpy()))
        flat = adds.flatten()
        table[flat.field("lang").to_numpy(), owner] = flat.field("x").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(names)}, table))

    def of(batches):
        places, table = shared.value
        none = table.shape[1] - 1
        for batch, texts in text_chunks(batches):
            words = [_letters(words_of(x)) for x in texts]
            counts = np.array([len(x) for x in words])
            filled = np.nonzero(counts)[0]
            flat = [w for x in words for w in x]
            place = np.fromiter(map(places.get, flat, repeat(none)), np.int64, len(flat))
            sums = np.zeros((len(texts), size + 1))
            if len(filled):
                start = starts_of(counts)[filled]
                for k in range(size + 1):
                    sums[filled, k] = np.add.reduceat(table[k][place], start)
            other = np.nonzero(place == none)[0]
            owner = np.repeat(np.arange(len(texts)), counts)[other]
            tail = Counter(zip(owner.tolist(), [flat[k] for k in other.tolist()], strict=True))
            ends = np.append(0, np.cumsum(np.bincount(np.array([d for d, _ in tail], np.int64), minlength=len(texts))))
            pairs = pa.StructArray.from_arrays([pa.array([w for _, w in tail], pa.string()), pa.array(list(tail.values()), pa.int32())], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(list(sums), pa.list_(pa.float64())), lists], ["doc_id", "held_out", "n_words", "sums", "rest"])

    rows = doc_text(docs, held_out().alias("held_out")).mapInArrow(of, "doc_id long, held_out boolean, n_words long, sums array<double>, rest array<struct<word:string,times:int>>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", F.inline("rest")).join(scores.select("word", "adds"), "word").select("row", "times", F.inline("adds"))
    met = met.groupBy("row", "lang").agg(F.sum(F.col("times") * F.col("x")).alias("x")).groupBy("row").agg(F.collect_list(F.struct("lang", "x")).alias("more"))

    def decided(batches):
        for batch in batches:
            counts = batch.column(2).to_numpy()
            total = np.array(batch.column(3).to_pylist(), float).reshape(len(counts), size + 1)
            for d, more in enumerate(batch.column(4).to_pylist()):
                for m in more or ():
                    total[d, m["lang"]] += m["x"]
            total = (total[:, :size] + total[:, size:] * base)[:, learned]
            names, best = ["und"] * len(counts), np.zeros(len(counts))
            if learned and len(counts):
                total = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(1, counts))[:, None]
                best = np.where(counts > 0, 1 / np.exp(total).sum(axis=1), 0.0)
                names = [langs[learned[k]] if n else "und" for k, n in zip(total.argmax(axis=1).tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    whole = rows.drop("rest").join(met, "row", "left").select("doc_id", "held_out", "n_words", "sums", "more")
    return whole.mapInArrow(decided, "doc_id long, held_out boolean, lang_pred string, score double")
