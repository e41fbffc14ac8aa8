import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from checks import DATA, same_rows

from cortexa.llm import line_dedup as ld, queries

BLANKS = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(pairs, least_chars=20, least_docs=3):
    holders = defaultdict(list)
    for i, (doc_id, text) in enumerate(pairs):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(doc_id)
    out = []
    for doc_id, text in pairs:
        lines, kept = (text or "").split("\n"), []
        for x in lines:
            ids = holders[key(x)]
            last = max((i for i in ids if i is not None), default=None)
            if len(key(x)) < least_chars or len(ids) < least_docs or doc_id == last:
                kept.append(x)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


LONG = "a line that is long enough"
ODD = [
    (1, None),
    (2, ""),
    (3, f"{LONG}\nshort\n{LONG}"),
    (4, f"\t{LONG.upper()} \r\nshort"),
    (5, f"x\n{LONG}\n\n{LONG}\n"),
    (5, f"x\n{LONG}"),
    (5, f"x\n{LONG}"),
    (None, f"{LONG}\nno one else has this line\nonly those without an id have it"),
    (None, "only those without an id have it\nshort"),
    (None, "only those without an id have it\nshort"),
    (6, "é" * 19 + "\n" + "É" * 20),
    (7, "é" * 19 + "\n" + "É" * 20),
    (8, "é" * 19 + "\n" + "É" * 20 + "\n" + "é" * 20),
    (9, "\n".join(f"line {i % 5000} of a text with very many lines" for i in range(20_000))),
    (10, "\n".join(f"line {i} of a text with very many lines" for i in range(10))),
    (11, "\n".join(f"Line {i} of a text with very many lines" for i in range(5, 15))),
    (12, "w" * 200_000),
    (13, "w" * 200_000),
    (14, "W" * 200_000 + "\v"),
]


def test_odd_rows(docs_of):
    assert rows(ld.line_dedup(docs_of(ODD))) == brute(ODD)
    assert rows(ld.line_dedup(docs_of([]))) == []
    assert rows(ld.line_dedup(docs_of(ODD), texts=False)) == sorted((r[:4] for r in brute(ODD)), key=repr)


def some_docs(rng, ids):
    lines = [f"{'shared' if i < 4 else 'rarer'} line number {i} of this test" for i in range(60)] + ["short"]
    return [(i, "\n".join(rng.choice(lines[:4] if rng.random() < 0.4 else lines) for _ in range(rng.randrange(0, 12)))) for i in ids]


@pytest.mark.parametrize("options", [{}, {"filter_bytes": 0}, {"hot_share": 2}, {"hot_share": 10**9}, {"drop_bytes": 0}])
def test_ways_agree(spark, docs_of, tmp_path, options):
    docs = some_docs(random.Random(1), range(200))
    index = ld.LineIndex.begun(spark, str(tmp_path / "index"), shards=5)
    index.insert(docs_of(docs))
    assert rows(index.dedup(docs_of(docs), **options)) == brute(docs)


def test_insertions_and_deletions_leave_no_trace(spark, docs_of, tmp_path):
    rng = random.Random(2)
    held, folder = {}, str(tmp_path / "index")
    index = ld.LineIndex.begun(spark, folder, shards=3)
    for step in range(6):
        new = [i for i in rng.sample(range(60), 25) if i not in held]
        more = some_docs(rng, new)
        index.insert(docs_of(more))
        held |= dict(more)
        if step % 2:
            gone = rng.sample(sorted(held), 15) + ([max(held)] if step == 3 else [])
            index.delete(docs_of([(i, None) for i in [*gone, 999, None]]))
            held = {i: t for i, t in held.items() if i not in gone}
        index = ld.LineIndex(spark, folder)  # opened anew from its tables
        pairs = sorted(held.items())
        assert rows(index.dedup(docs_of(pairs))) == brute(pairs)
        fresh = ld.LineIndex.begun(spark, str(tmp_path / f"fresh-{step}"), shards=3)
        fresh.insert(docs_of(pairs))
        assert rows(index.counts().select("k0", "k1", "docs", "last")) == rows(fresh.counts().select("k0", "k1", "docs", "last"))
        assert index.pairs == fresh.pairs
        for r in index._read(f"filters-{index.version}").collect():  # what has left is not in the filters, what stays is
            keys = {x["k0"] for x in index.counts().where("docs >= 3").where(index._shard() == r["shard"]).collect()}
            cuckoo = ld.Cuckoo.load(r["slots"])
            assert (cuckoo.slots > 0).sum() == len(keys)
            assert all(k % 2**64 in cuckoo for k in keys)


def test_everything_deleted(spark, docs_of, tmp_path):
    docs = some_docs(random.Random(4), range(30))
    index = ld.LineIndex.begun(spark, str(tmp_path / "index"))
    index.insert(docs_of(docs))
    index.delete(docs_of(docs))
    assert index.counts().count() == 0 and index.pairs == 0
    index.insert(docs_of(docs[:10]))
    assert rows(index.dedup(docs_of(docs[:10]))) == brute(docs[:10])


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 20_000, np.uint64))
    cuckoo = ld.Cuckoo.sized(len(keys))
    assert cuckoo.insert(keys[:15_000]) and cuckoo.insert(keys[15_000:])
    assert cuckoo.has(keys).all()
    cuckoo.delete(keys[::2])
    assert cuckoo.has(keys[1::2]).all() and (cuckoo.slots > 0).sum() == len(keys[1::2])
    assert cuckoo.has(keys[::2]).mean() < 0.01
    assert cuckoo.has(rng.integers(0, 2**64, 20_000, np.uint64)).mean() < 0.01
    with pytest.raises(KeyError):
        cuckoo.delete(keys[::2])
    small = ld.Cuckoo(np.zeros((2, 4), np.uint16))
    assert not small.insert(keys[:9])


def test_full_filters_are_made_anew(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(ld.Cuckoo, "sized", classmethod(lambda cls, keys: cls(np.zeros((1 << max(1, keys // 8).bit_length(), 4), np.uint16))))
    docs = some_docs(random.Random(5), range(120))
    index = ld.LineIndex.begun(spark, str(tmp_path / "index"), shards=1)
    index.insert(docs_of(docs))
    assert rows(index.dedup(docs_of(docs))) == brute(docs)


def test_query_matches_sql(spark, duck):
    same_rows(queries.QUERIES["op11_line_dedup"](spark, DATA), queries.SQL["op11_line_dedup"], duck)
