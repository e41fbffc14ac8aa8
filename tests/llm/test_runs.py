import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from checks import DATA

from cortexa.llm import periodic_runs as pr, queries


def brute_runs(words):
    """Every run from the definition: for each period the maximal stretches, the smallest period of each."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *four, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def got(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[x] for x in names) for r in df.collect()), key=repr)


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def random_words(rng):
    """Words of a small vocabulary with stretches that repeat, of several periods."""
    words = []
    while len(words) < rng.randrange(0, 150):
        unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 14))]
        words += unit * rng.choice([1, 1, 2, 3, 4, 9, 30]) + unit[: rng.randrange(0, len(unit) + 1)]
    return words


@pytest.mark.parametrize("pairs", [1, 7, 1 << 19])
def test_runs_against_the_definition(pairs):
    rng = random.Random(pairs)
    some = 0
    for _ in range(200):
        words = random_words(rng)
        want = brute_runs(words)
        some += len(want)
        assert pr.runs_of(numbers(words), pairs=pairs) == want
    assert some > 100


def test_wrong_hashes_are_found_out():
    def blind(ids):  # says that all stretches are equal
        return np.ones(len(ids) + 1, np.uint64), np.zeros(len(ids) + 1, np.uint64)

    def weak(ids):  # counts words only
        return np.ones(len(ids) + 1, np.uint64), np.concatenate(([0], np.cumsum(ids.astype(np.uint64) % np.uint64(2)))).astype(np.uint64)

    rng = random.Random(3)
    for _ in range(40):
        words = random_words(rng)
        for hashes in (weak, blind):
            assert pr.runs_of(numbers(words), hashes=hashes) == brute_runs(words)


def test_grid_points_are_few_and_within_bounds():
    n = 60_000
    sizes = [len(p) for p, at in pr.grid(n) if (at >= 0).all() and (at + p < n).all()]
    assert sum(sizes) < n * np.log(n) and max(sizes) < 2 * pr.PAIRS


ODD = [
    (1, None),
    (2, ""),
    (3, "a " * 23),
    (4, "a " * 24),
    (4, "a " * 24),
    (None, "x " + "a b\t" * 12),
    (None, None),
    (5, "word " * 30_000),
    (6, " ".join(f"w{i % 9}" for i in range(27)) + " é " + "é É " * 20),
    (7, " ".join(["p q"] * 12 + ["r"] * 24 + ["p q"] * 12)),
    *((i, " ".join(f"t{k}" for k in range(i))) for i in range(20, 90)),
]


def test_odd_rows(docs_of):
    found = pr.run_digests(pr.periodic_runs(pr.planted(docs_of(ODD))))
    assert got(found) == sorted((brute_row(*r) for r in ODD), key=repr)
    assert pr.periodic_runs(docs_of([])).collect() == []
    texts = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in pr.periodic_runs(docs_of(ODD[2:4] + ODD[7:8])).collect()}
    assert texts == {3: (" ".join("a" * 23), []), 4: ("a", [(0, 24, 1)]), 5: ("word", [(0, 30_000, 1)])}


def test_query_against_the_definition(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    short = [r for r in docs if len((r[1] or "").split()) < 1500]
    want = {r[0]: r for r in (brute_row(*x) for x in short)}
    rows = [r for r in got(queries.QUERIES["op12_periodic_runs"](spark, DATA))]
    assert len(rows) == len(docs)
    assert {r[0]: r for r in rows if r[0] in want} == want
    assert sum(r[1] > 0 for r in want.values()) >= len(want) / 20
