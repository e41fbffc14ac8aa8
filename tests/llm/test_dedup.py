import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from checks import DATA, same_rows

from cortexa.llm import common, exact_dedup, queries, simhash, substring_dedup

ODD = [(1, None), (2, ""), (3, "a  b\tc"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (None, None), (5, "word " * 30_000), (6, " a b c"), (7, "é ÉÀ x")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_exact(pairs):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs]
    out = []
    for (i, _), text in zip(pairs, norm, strict=True):
        ids = [j for (j, _), other in zip(pairs, norm, strict=True) if other == text]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_odd_rows(docs_of):
    assert rows(exact_dedup.exact_dedup(docs_of(ODD))) == brute_exact(ODD)
    assert rows(exact_dedup.exact_dedup(docs_of([]))) == []


@pytest.mark.parametrize("salts", [1, 3])
def test_salts_do_not_matter(docs_of, salts):
    assert rows(exact_dedup.exact_dedup(docs_of(ODD), salts)) == brute_exact(ODD)


@pytest.mark.parametrize("limit", [0, 100])
def test_rows_without_what_is_gone(docs_of, limit):
    docs = docs_of(ODD)
    kept = common.without(docs, docs.select("doc_id").where("doc_id in (4, 7) or doc_id is null"), limit)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id", "text")) == sorted((x for x in ODD if x[0] not in (4, 7)), key=repr)


def test_exact_dedup_compares_contents_under_equal_digests(docs_of, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda text="norm": F.lit(b"same"))
    assert [r[:4] for r in rows(exact_dedup.exact_dedup(docs_of(ODD)))] == [r[:4] for r in brute_exact(ODD)]


def test_exact_dedup_matches_sql(spark, duck):
    same_rows(queries.QUERIES["op6_exact_dedup"](spark, DATA), queries.SQL["op6_exact_dedup"], duck)


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    values = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(pairs):
    prints = [brute_fingerprint(t) for _, t in pairs]
    own = list(range(len(pairs)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                own[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(pairs):
        ids = [j for m, (j, _) in enumerate(pairs) if root(m) == root(k) and j is not None]
        out.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash_matches_brute_force(docs_of, bucket):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    near = []
    for k in range(40):  # a chain of near copies, so that buckets hold many
        base = base.copy()
        base[rng.randrange(len(base))] = f"v{k}"
        near.append((100 + k, " ".join(base)))
    other = [(200 + k, " ".join(f"u{rng.randrange(99)}" for _ in range(rng.randrange(1, 40)))) for k in range(20)]
    pairs = [*ODD, *near, *other]
    assert rows(simhash.near_duplicates(docs_of(pairs), bucket=bucket)) == brute_components(pairs)
    assert rows(simhash.near_duplicates(docs_of([]))) == []


def test_simhash_query_matches_brute_force(spark):
    pairs = [(r.doc_id, r.text) for r in common.documents(spark, DATA).select("doc_id", "text").collect()]
    assert rows(queries.QUERIES["op2_simhash_near_dedup"](spark, DATA)) == brute_components(pairs)


def test_balls_meet_exactly_within_the_distance(spark):
    rng = np.random.default_rng(1)
    start = rng.integers(0, 1 << 62)
    values = sorted({int(start) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(60)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    want = [(a, b) for a, in signed for b, in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    same = simhash.linked(np.array(values, np.uint64).view(np.int64), 4)
    assert groups(signed, zip(*(x.tolist() for x in same), strict=True)) == groups(signed, want)
    for bucket in (4096, 1):
        got = simhash.links(fps, bucket=bucket).collect()
        assert groups(signed, [(r.a, r.b) for r in got]) == groups(signed, want)
    with pytest.raises(ValueError):
        simhash.links(fps, distance=3)


def groups(nodes, links):
    own = {n: n for (n,) in nodes}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        own[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in own}


def brute_substring(pairs):
    """First starts by (doc_id, start) among rows with an id; rows of one id do not precede one another."""
    where = {}
    words = [(t or "").encode().split() for _, t in pairs]
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            for s in range(len(words[k]) - 19):
                where.setdefault(tuple(words[k][s : s + 20]), []).append((i, k, s))
    out = []
    for k, (i, _) in enumerate(pairs):
        gone = set()
        for s in range(len(words[k]) - 19) if i is not None else ():
            if any(j < i or (m == k and r < s) for j, m, r in where[tuple(words[k][s : s + 20])]):
                gone |= set(range(s, s + 20))
        kept = b" ".join(w for p, w in enumerate(words[k]) if p not in gone)
        out.append((i, len(words[k]), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def test_substring_dedup_matches_brute_force(docs_of):
    rng = random.Random(5)
    text = lambda n, v=30: [f"{rng.choice('abc')}{rng.randrange(v)}" for _ in range(n)]
    shared = [text(rng.randrange(15, 60)) for _ in range(6)]
    pairs = [(1, None), (2, ""), (3, "same " * 50), (4, "same " * 25), (None, " ".join(shared[0] * 2)), (5, "x " * 3)]
    for k in range(10, 50):
        parts = [text(rng.randrange(1, 40)), rng.choice(shared), text(rng.randrange(1, 10)), rng.choice(shared), text(3)]
        if k % 7 == 0:
            parts.append(parts[1])
        pairs.append((k, "\n".join(" ".join(p) for p in parts)))
    pairs += [(60, pairs[10][1]), (60, pairs[10][1]), (61, pairs[11][1].upper())]
    rng.shuffle(pairs)
    whole = substring_dedup.substring_dedup(docs_of(pairs)).cache()
    assert rows(whole.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")) == brute_substring(pairs)
    words = {i: (t or "").split() for i, t in pairs}
    factors = 0
    for r in whole.where("doc_id is not null").collect():  # each factor is a copy of what stands where it points, and starts behind the one before
        end = 0
        for f in r.factors:
            assert f.start >= end and f.size >= 20 and (f.ref_id, f.ref_start) < (r.doc_id, f.start)
            assert words[f.ref_id][f.ref_start : f.ref_start + f.size] == words[r.doc_id][f.start : f.start + f.size]
            end, factors = f.start + f.size, factors + 1
        assert r.n_factors == len(r.factors) and r.longest_factor == max((f.size for f in r.factors), default=0)
    assert factors > 40
    assert substring_dedup.substring_dedup(docs_of(pairs), texts=False).columns == whole.columns[:6]
    assert rows(substring_dedup.substring_dedup(docs_of([]))) == []


def test_substring_dedup_matches_sql(spark, duck):
    same_rows(queries.QUERIES["op7_substring_dedup"](spark, DATA), queries.SQL["op7_substring_dedup"], duck)


def passages(rng):
    """Documents that share passages cut off at different words, so that blocks agree in part."""
    words = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(120)]
    out = []
    for k in range(40):
        a = rng.randrange(60)
        own = [f"own{k}-{i}" for i in range(30)]
        out.append((k, " ".join(own[:15] + words[a : a + rng.randrange(20, 60)] + own[15:])))
    return out


def test_extension_decides_what_goes(docs_of, monkeypatch):
    pairs = passages(random.Random(6))
    found = lambda: rows(substring_dedup.substring_dedup(docs_of(pairs)).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"))
    assert found() == brute_substring(pairs)
    for wrong in (lambda *a: (0, 0), lambda w, a, o, b: (a, len(w) - a)):  # ends at once; never ends within a block
        wrong.__module__ = "__main__"  # sent to the tasks by value
        monkeypatch.setattr(substring_dedup, "extent", wrong)
        assert found() != brute_substring(pairs)


def test_extent():
    a, b = "p q r a1 a2 a3 a4 a5 a6 s t".split(), "q r a1 a2 a3 a4 a5 a6 s u v".split()
    assert substring_dedup.extent(a, 3, b, 2) == (2, 7)
    assert substring_dedup.extent(a, 3, ["z"] * 2 + b[2:], 2) == (0, 7)
    assert substring_dedup.extent(a, 3, b[:5] + ["z"] + b[6:], 2) == (0, 0)


def test_few_windows_are_looked_up(spark, docs_of):
    """Boundary windows are those that a reference block does not have."""
    pairs = passages(random.Random(7))
    dealt, spans = substring_dedup.duplicate_spans(docs_of(pairs))
    some = spans.collect()
    assert sum(r.size for r in some if r.size > 1) > 3 * sum(r.size == 1 for r in some)
    words = {k: t.split() for k, t in pairs}
    for r in some:
        assert (r.ref_id, r.ref_start) < (r.doc_id, r.start)
        n = r.size + substring_dedup.WINDOW - 1
        assert words[r.doc_id][r.start : r.start + n] == words[r.ref_id][r.ref_start : r.ref_start + n]


def test_parse_is_greedy():
    ref = np.array([7, 8, 9, 0, 4, 5, 30, 31, 32, 33, 0, 0, 60])
    found = np.array([1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 0, 1], bool)
    first, last = substring_dedup.parsed(found, np.ones(13, np.int64), ref, window=3)
    # Windows 0-2 cover words 0-4; window 5 goes on for one word; 8-9 end at word 11; 12 stands alone.
    assert (first.tolist(), last.tolist()) == ([0, 5, 8, 12], [2, 5, 9, 12])
    gone = substring_dedup.removed(15, found, first, last, window=3)
    assert gone.tolist() == [any(found[k] for k in range(max(0, w - 2), min(13, w + 1))) for w in range(15)]


def test_rolling_hashes():
    values = np.arange(1, 40, dtype=np.uint64)
    for size in (1, 2, 5, 6, 20):
        want = [sum(int(values[i + j]) * pow(common.BASE_A, size - 1 - j, 2**64) for j in range(size)) % 2**64 for i in range(len(values) - size + 1)]
        assert common.rolling(values, size, common.BASE_A).tolist() == want
    assert len(common.rolling(values[:3], 5, common.BASE_A)) == 0
