import gzip
import struct

import numpy as np
import pytest

from cortexa.sources import files, ranged


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.name, r.row, r.node, list(r.x)) for r in df.collect())


def test_arrays_of_every_layout(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, f, i, one, wide = rng.normal(size=(50, 3)), np.asfortranarray(rng.normal(size=(40, 4))), np.arange(60, dtype=np.int16).reshape(20, 3), np.arange(7.0), rng.normal(size=(5, 2, 3))
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "f.npy", f)
    np.savez(tmp_path / "plain.npz", i=i, one=one, f=f)
    np.savez_compressed(tmp_path / "small.npz", i=i, f=f, wide=wide)
    (tmp_path / "notes.txt").write_text("not an array")
    want = [(n, k, r, None, np.atleast_1d(x).astype(float).ravel().tolist()) for n, k, y in [("a.npy", "", a), ("f.npy", "", f), ("plain.npz", "i", i), ("plain.npz", "one", one), ("plain.npz", "f", f), ("small.npz", "i", i), ("small.npz", "f", f), ("small.npz", "wide", wide)] for r, x in enumerate(y)]
    for size in (1, 200, 1 << 20):
        df = ranged.read_rows(spark, str(tmp_path), range_bytes=size)
        assert rows(df) == sorted(want)
    assert ranged.read_rows(spark, f"file://{tmp_path}/a.npy", range_bytes=100).rdd.getNumPartitions() == 13  # 4 rows of 24 bytes in each
    np.save(tmp_path / "text.npy", np.array(["x"]))
    with pytest.raises(Exception, match="are not numbers"):
        ranged.read_rows(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("order", ["<", ">"])
def test_images(spark, tmp_path, order):
    x = np.arange(4 * 3 * 2 * 5, dtype=np.int16).reshape(4, 3, 2, 5)
    head = bytearray(352)
    struct.pack_into(f"{order}i", head, 0, 348)
    struct.pack_into(f"{order}8h", head, 40, 4, 4, 3, 2, 5, 1, 1, 1)
    struct.pack_into(f"{order}2h", head, 70, 4, 16)
    struct.pack_into(f"{order}3f", head, 108, 352.0, 0.5, 2.0)
    head[344:348] = b"n+1\0"
    (tmp_path / "image.nii").write_bytes(bytes(head) + x.astype(f"{order}i2").tobytes(order="F"))
    want = [("image.nii", "", i + 4 * (j + 3 * k), None, (x[i, j, k] * 0.5 + 2).tolist()) for i in range(4) for j in range(3) for k in range(2)]
    assert rows(ranged.read_rows(spark, str(tmp_path), range_bytes=50)) == sorted(want)
    (tmp_path / "image.nii").write_bytes(gzip.compress(bytes(400)))
    with pytest.raises(Exception, match="no single-file NIfTI-1"):
        ranged.read_rows(spark, str(tmp_path)).collect()


def test_written_rows_are_read(spark, tmp_path):
    path = str(tmp_path / "out")
    data = [(k, [float(k), k / 3, -1.0]) for k in range(200)] + [(-5, [0.5])]  # of two widths
    df = spark.createDataFrame(data, "node long, x array<float>").repartition(3)
    for compressed in (False, True):
        ranged.write_rows(df, f"{path}-{compressed}", compressed, range_bytes=500)
        got = ranged.read_rows(spark, f"{path}-{compressed}", index="node", range_bytes=300)
        assert sorted((r.node, list(r.x)) for r in got.collect()) == sorted((n, np.array(x, np.float32).astype(float).tolist()) for n, x in data)
        with pytest.raises(Exception, match="written already"):
            ranged.write_rows(df, f"{path}-{compressed}")
    ranged.write_rows(df.limit(1), f"{path}-True", overwrite=True)
    assert ranged.read_rows(spark, f"{path}-True", index="node").count() == 1
    ranged.write_rows(df.limit(0), f"{path}-empty")
    assert ranged.read_rows(spark, f"{path}-empty", index="node").collect() == []


def test_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "out"
    df = spark.range(0, 40, 1, 4).select(F.col("id").alias("node"), F.when(F.col("id") == 25, F.raise_error(F.lit("broken"))).otherwise(F.array(F.lit(1.0))).alias("x"))
    with pytest.raises(Exception, match="broken"):
        ranged.write_rows(df, str(path))
    assert not list(path.glob("part-*")) and not (path / "_SUCCESS").exists()


@pytest.mark.parametrize("size", ["7b", "64b", "1m"])
def test_lines_of_split_files(spark, tmp_path, size):
    texts = {"a.csv": "".join(f"{k},{k * k}\n" for k in range(300)), "b.csv": "1\r\n22\r\n\r\n4", "c.csv": "", "d.csv": "x" * 500 + "\n" + "y"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.read_lines(spark, str(tmp_path))
        assert size == "1m" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = sorted((r.path.rsplit("/", 1)[-1], r.line, r.value) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(name, k, v.rstrip("\r")) for name, text in texts.items() for k, v in enumerate(text.removesuffix("\n").split("\n") if text else [])]
    assert got == sorted(want)
