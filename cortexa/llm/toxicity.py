"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other training text counts as
unlabelled, whatever its label. With the class prior p, the risk of calling
unlabelled text clean is corrected by the positives that it must contain:

    risk = p * R(positives as toxic) + max(0, R(unlabelled as clean) - p * R(positives as clean))

A numpy classifier, linear in the presence of words and word beginnings,
minimises it. Its terms are those whose share of the positives stands out from
their share of all training text, which is counted in full. Only the fit is
over a bounded sample of documents; everything else runs over all rows on the
executors.
"""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import doc_text, plain_words, text_chunks

#: The fit's bounds, in documents: positives, and unlabelled ones.
POSITIVES, UNLABELLED = 4_000, 12_000
#: The standard errors by which the odds of a term must stand out, and the prior where no training row is labelled clean.
EVIDENCE, PRIOR = 4.0, 0.1
#: UTF-8 bytes of the positives' texts in all, whose terms the driver sees.
POSITIVE_BYTES = 32 << 20
FOLDS = 5


class Model(NamedTuple):
    """Weights of the terms and what a text without any of them has."""

    weights: dict[bytes, float]
    bias: float


def words_of(text: bytes) -> list[bytes]:
    return plain_words(text.decode("utf-8", "replace").lower().encode())


def terms(word: bytes) -> tuple[bytes, ...]:
    """A word and, if it is longer, its beginning, which a star (no word has one) tells from a word."""
    return (word, word[:5] + b"*") if len(word) > 5 else (word,)


class Places(dict):
    """Where a word's terms stand among the chosen ones, remembered up to a bound."""

    def __init__(self, names: list[bytes]):
        self.names = {x: i for i, x in enumerate(names)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = tuple(self.names[t] for t in terms(word) if t in self.names)
        return value

    def of(self, text: bytes) -> set[int]:
        return {i for w in set(words_of(text)) for i in self[w]}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _share(part: int, whole: int):
    """Rows of a share part / whole of all ids, the same ones at any partitioning."""
    share = min(1.0, part / max(1, whole))
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))


def _documents_with(rows: DataFrame) -> dict[bytes, int]:
    """The terms that more than one of the rows has, and how many have them."""

    def of(batches):
        for _, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([t for x in texts for t in {t for w in set(words_of(x)) for t in terms(w)}], pa.binary())], ["term"])

    found = rows.select("doc_id", "text").mapInArrow(of, "term binary").groupBy("term").count().where("count > 1")
    return {bytes(r["term"]): r["count"] for r in found.collect()}


def _sets(rows: DataFrame, most: int, names: list[bytes]) -> list[np.ndarray]:
    """Sorted places in ``names`` of the rows' terms, at most ``most`` rows, the first by a hash of their ids."""
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def of(batches):
        places = Places(shared.value)
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(sorted(places.of(x)), np.int32).tobytes() for x in texts], pa.binary())], ["doc_id", "terms"])

    found = rows.select("doc_id", "text").mapInArrow(of, "doc_id long, terms binary")
    found = found.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "terms").limit(most)
    return [np.frombuffer(r["terms"], np.int32) for r in found.collect()]


def _counted(rows: DataFrame, names: list[bytes]) -> np.ndarray:
    """In how many of all rows each of the terms is."""
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def of(batches):
        places = Places(shared.value)
        total = np.zeros(len(places.names), np.int64)
        for _, texts in text_chunks(batches):
            found = [places.of(x) for x in texts]
            total += np.bincount(np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found))), minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(len(names), np.int64)
    for r in rows.select("doc_id", "text").mapInArrow(of, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _within(rows: list, most_bytes: int) -> list[int]:
    """The ids of (id, bytes) rows, in order, that still fit."""
    chosen, held = [], 0
    for doc_id, size in rows:
        if held + size <= most_bytes:
            chosen.append(doc_id)
            held += size
    return chosen


def standing_out(positive: np.ndarray, n_positive: int, every: np.ndarray, n_every: int) -> np.ndarray:
    """Which terms have odds that differ from those in all text, from the numbers of documents that have them."""
    p, u = positive + 0.5, every + 0.5
    odds = np.log(p / (n_positive + 1)) - np.log(u / (n_every + 1))
    return np.abs(odds) / np.sqrt(1 / p + 1 / u) >= EVIDENCE


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, positive_bytes: int = POSITIVE_BYTES) -> Model:
    """Fit on about ``positives`` and ``unlabelled`` documents of the training fold, at most twice as many, drawn by hashes of their ids.

    Of the positives drawn, those that still fit into ``positive_bytes`` in all
    are used. The terms, of the positives, are chosen by counts over all
    training documents. Of several labels of a document the largest holds; rows
    that repeat an id are documents of their own with one label.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("doc_id is not null and toxic is not null").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, labelled = marks.agg(F.sum(F.expr("int(toxic = 1)")), F.count("*")).first()
    text = doc_text(docs).where(~held_out()).where("doc_id is not null")
    total = text.count()
    if not toxic or not total:
        return Model({}, -20.0)
    prior = toxic / labelled if toxic < labelled else PRIOR
    # The limits bound what is sent to the tasks; the share before them draws about half as many.
    by_hash = F.xxhash64("doc_id", F.lit(5))
    chosen = marks.where("toxic = 1").where(_share(positives, toxic)).select("doc_id").orderBy(by_hash).limit(2 * positives)
    sizes = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    ids = [(x,) for x in _within([tuple(r) for r in sizes.orderBy(by_hash).collect()], positive_bytes)]
    confirmed = text.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id")
    # Terms of fewer than two positives cannot stand out; without them the rest is small.
    seen = _documents_with(confirmed)
    names = sorted(seen)
    if not names:
        return Model({}, -20.0)
    out = standing_out(np.array([seen[x] for x in names]), confirmed.count(), _counted(text, names), total)
    names = [x for x, stays in zip(names, out.tolist(), strict=True) if stays]
    sets, drawn = _sets(confirmed, 2 * positives, names), _sets(text.where(_share(unlabelled, total)), 2 * unlabelled, names)
    return fit(names, [*sets, *drawn], np.arange(len(sets) + len(drawn)) < len(sets), prior)


def fit(names: list[bytes], sets: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 250, rate: float = 0.1, decay: float = 3e-4) -> Model:
    """Minimise the non-negative risk over documents given as sets of places in the terms ``names``, by full-batch Adam."""
    if not positive.any() or positive.all() or not names:
        return Model({}, -20.0)
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    w, b = np.zeros(len(names)), 0.0
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    pos, unl = positive, ~positive
    for t in range(1, steps + 1):
        g = np.bincount(doc, w[flat], len(sets)) + b
        as_clean = np.logaddexp(0, g)
        slope = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
        d = np.zeros(len(sets))
        rest = as_clean[unl].mean() - prior * as_clean[pos].mean()
        if rest >= 0:
            d[pos] = prior * (slope[pos] - 1) / n_pos - prior * slope[pos] / n_pos
            d[unl] = slope[unl] / n_unl
        else:  # the corrected part is overfitted: step back along it alone
            d[pos] = prior * slope[pos] / n_pos
            d[unl] = -slope[unl] / n_unl
        grad = np.append(np.bincount(flat, d[doc], len(w)) + decay * prior * w, d.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        step = rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(dict(zip(names, w.tolist(), strict=True)), float(b))


def _scores(texts: list[bytes], model: Model, cache: dict) -> np.ndarray:
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        found = {}
        for word in set(words_of(text)):
            if (known := cache.get(word)) is None:
                if len(cache) >= 300_000:
                    cache.clear()
                cache[word] = known = {t: model.weights[t] for t in terms(word) if t in model.weights}
            if known:
                found.update(known)
        out[i] = model.bias + sum(found.values())
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts score as texts without any known term."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def of(batches):
        cache: dict = {}
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_scores(texts, Model(*shared.value), cache))], ["doc_id", "held_out", "score"])

    rows = doc_text(docs, held_out().alias("held_out")).mapInArrow(of, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", F.expr("int(score >= 0.5)"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, by a model of the labelled fold.

    A null id is never trained on and counts as not held out. Null and empty
    texts score as texts without any known term. Rows that repeat an id or a
    text are scored each; several labels of a document count as the largest.
    Without a toxic training row all are called clean. Other columns are
    ignored; an empty table gives none.
    """
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not call toxic: null and empty texts and repeated rows too."""
    shared, at = docs.sparkSession.sparkContext.broadcast(tuple(model)), docs.columns.index("text")

    def of(batches):
        cache: dict = {}
        for batch, texts in text_chunks(batches, at):
            yield batch.filter(pa.array(_scores(texts, Model(*shared.value), cache) < 0.5))

    return docs.mapInArrow(of, docs.schema)
