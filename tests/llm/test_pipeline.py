"""The pipeline against a brute-force version of each stage, each on its own input."""

import corpus_pipeline as pipeline
from checks import DATA
from test_dedup import brute_components, brute_exact
from test_scans import brute_contained

from cortexa.llm import common, packing, toxicity


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    docs = common.documents(spark, DATA)
    columns = docs.columns
    kept = [pairs(docs)]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
            kept.append(pairs(docs))
    whole, clean, single, apart, fair = kept
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = toxicity.toxicity(common.documents(spark, DATA), labels).collect()
    assert sorted(clean) == sorted((i, t) for i, t in whole if i in {r.doc_id for r in scores if not r.predicted})
    assert sorted(i for i, _ in single) == sorted(r[0] for r in brute_exact(clean) if r[3])
    assert sorted(i for i, _ in apart) == sorted({r[2] for r in brute_components(single)})
    items = pairs(spark.read.parquet(f"{DATA}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    leaked = {r[0] for r in brute_contained(apart, items)}
    assert sorted(i for i, _ in fair) == sorted(i for i, _ in apart if i not in leaked)
    words = {i: len(t.encode().split()) for i, t in fair}
    held = {}
    for r in docs.collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + r.n_words
        assert r.bin_size in packing.CAPACITIES
    assert held == words


def test_stages_on_odd_rows(spark, docs_of, tmp_path):
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = "zero one two three four five six seven eight"
    odd = [(1, "a b"), (2, "a  b"), (3, None), (4, ""), (None, "a b"), (5, leak), (5, "other text of the same id"), (6, "x " * 20_000), (6, "x " * 20_000)]
    kept = []
    for rows in (odd, []):
        docs = docs_of(rows)
        columns = docs.columns
        for k, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(path := str(tmp_path / f"{len(rows)}-{k}"))
            docs = spark.read.parquet(path)
            assert k == 4 or docs.columns == columns
            kept.append(sorted((r.doc_id for r in docs.collect()), key=repr))
    assert kept[0] == sorted([1, 2, 3, 4, None, 5, 5, 6, 6], key=repr)
    assert kept[1] == sorted([1, 3, None, 5, 5, 6, 6], key=repr)  # 2 is a copy of 1, 4 of 3
    assert kept[3] == sorted([1, 3, None, 6, 6], key=repr)
    assert set(kept[4]) == {1, 3, None, 6} and kept[5:] == [[]] * 5


def test_run(spark):
    got = pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "part", "start_word", "n_words", "bin_id", "bin_size", "bin_offset"]
    assert got.count() > 50
    assert pipeline.ORACLE_SQL is None
