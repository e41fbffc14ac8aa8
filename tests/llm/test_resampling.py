import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from checks import DATA, same_rows

from cortexa.llm import common, queries, resampling as rs


def grams(text, orders):
    words = common.plain_words((text or "").encode())
    return words, [b" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, orders=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda g: zlib.crc32(g) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, orders)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, orders)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in docs:
        words, found = grams(text, orders)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    enough = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def some_docs(rng, n):
    words = ["alpha", "beta", "Gamma", "délta", "e5", "zeta-eta", "ÉTÉ", "theta"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


ODD = [(1, None), (2, ""), (None, None), (3, "!?"), (4, "one"), (5, "a b " * 30_000), (6, "ties " * 20), (6, "ties " * 20), (None, "x y z " * 10), (None, "x y z " * 10)]


def texts_of(spark, target):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(target)], "item_id long, text string, bucket string, gain string")


@pytest.mark.parametrize(("orders", "length", "percent"), [(1, 4096, 10), (2, 4096, 50), (3, 7, 30), (3, 2, 100), (5, 1, 20)])
def test_against_brute_force(spark, docs_of, orders, length, percent):
    docs = some_docs(random.Random(orders), 60)
    target = ["gamma délta e5", None, "", "zeta eta theta theta theta"]
    got = rs.resample(docs_of(docs), texts_of(spark, target), orders=orders, buckets=97, percent=percent, length=length)
    assert rows(got) == brute(docs, target, orders, 97, percent=percent)


def test_odd_rows(spark, docs_of):
    target = ["a b c", "ties"]
    assert rows(rs.resample(docs_of(ODD), texts_of(spark, target), percent=50)) == brute(ODD, target, percent=50)
    assert rows(rs.resample(docs_of(ODD[:6]), texts_of(spark, target), orders=2, percent=50)) == brute(ODD[:6], target, 2, percent=50)
    assert rows(rs.resample(docs_of(ODD), texts_of(spark, []))) == brute(ODD, [])
    assert rows(rs.resample(docs_of([]), texts_of(spark, target))) == []
    found = rs.resample(docs_of(ODD), texts_of(spark, target), percent=50)
    assert sorted(r.doc_id for r in rs.drawn(docs_of(ODD), found).collect()) == sorted(r[0] for r in ODD if r[0] in {x[0] for x in brute(ODD, target, percent=50) if x[4]})


def test_the_draw_leans_to_the_target(spark, docs_of):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["red", "green"] if i % 4 else ["red", "blue"]) for _ in range(40))) for i in range(400)]
    got = rs.resample(docs_of(docs), texts_of(spark, ["blue red blue"] * 50))
    assert all(r.doc_id % 4 == 0 for r in got.where("rank IS NOT NULL").collect())


def test_query_matches_sql(spark, duck):
    same_rows(queries.QUERIES["op13_importance_resampling"](spark, DATA), queries.SQL["op13_importance_resampling"], duck)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert rows(queries.QUERIES["op13_importance_resampling"](spark, DATA)) == brute(docs, target)
