import numpy as np
from pyspark.sql import functions as F

from cortexa.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("t\tfd\tcsf\n0\tn/a\t1.5\n1\t0.25\t2\n")
    df = files.read_table(spark, str(tmp_path / "c.tsv"), "t INT, fd DOUBLE, csf DOUBLE", sep="\t")
    assert [tuple(r) for r in df.orderBy("t").collect()] == [(0, None, 1.5), (1, 0.25, 2.0)]
    assert files.existing(df, ["csf", "nothing", "t"]).columns == ["csf", "t"]
    (tmp_path / "m.csv").write_text("1,2\n3,x\n")
    assert rows(files.read_matrix(spark, str(tmp_path / "m.csv")).fillna(-1.0), "i", "j", "w") == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, -1.0)]
    (tmp_path / "mu.txt").write_text(" 0.5 rest\n")
    assert rows(files.read_scalar(spark, str(tmp_path / "mu.txt")), "value") == [(0.5,)]
    (tmp_path / "lut.txt").write_text("# head\n# head\n 1   left  0.5\n\n 22  right 1\n")
    assert rows(files.read_spaced(spark, str(tmp_path / "lut.txt"), 2, {"k": (0, "int"), "name": (1, "string")}), "k", "name") == [(1, "left"), (22, "right")]


def test_arrays(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", x=a.astype("float32"), mask=np.array([True, False]), name=np.array(["s"]))
    df = files.read_arrays(spark, str(tmp_path / "*.np[yz]"))
    assert rows(df, "name", "shape") == [("", [2, 3]), ("mask", [2]), ("x", [2, 3])]
    assert rows(files.matrix_rows(df.where("name = ''")), "node", "x") == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    data = files.array_bytes(files.matrix_rows(df.where("name = ''")).select("node", "x")).orderBy("node").first().npy
    import io

    assert np.load(io.BytesIO(data)).tolist() == [0, 1, 2]


def test_sidecars(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"RepetitionTime": 2.3, "TaskName": "rest", "more": 1}')
    assert rows(files.read_sidecars(spark, str(tmp_path / "s.json")), "RepetitionTime", "TaskName") == [(2.3, "rest")]
    df = spark.createDataFrame([('{"a":1,"b":"x"}',)], "j string")
    got = files.with_key(df, "j", "a", F.lit(5)).select(F.from_json("j", "a string, b string").alias("s")).select("s.*")
    assert rows(got, "a", "b") == [("5", "x")]


def test_inventory_and_renaming(spark, tmp_path):
    for name in ("sub-01/ses-1/sub-01_ses-1_task-rest_run-2_bold.nii", "sub-01/ses-1/sub-01_ses-1_task-rest_run-1_bold.nii", "other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.inventory(files.listing(spark, str(tmp_path)))
    assert rows(found, "subject", "session", "task", "run") == [("01", "1", "rest", 1), ("01", "1", "rest", 2)]
    assert files.chosen_file(found, ["subject"]).first().filename.endswith("run-1_bold.nii")
    assert files.chosen_file(found, ["subject"], last=True).first().filename.endswith("run-2_bold.nii")
    plan = files.rename_plan(files.listing(spark, str(tmp_path)), [(r"_run-\d+", "")])
    assert rows(plan, "changed", "clashes") == [(False, False), (True, True), (True, True)]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda data: spark.createDataFrame(data, "s int, task string, n int")
    files.upsert(spark, path, frame([(1, "a", 5), (2, "a", 6)]), ["s", "task"])
    files.upsert(spark, path, frame([(2, "a", 9), (3, "b", 1), (3, "b", 2)]), ["s", "task"])
    assert rows(spark.read.parquet(path), "s", "task", "n") == [(1, "a", 5), (2, "a", 9), (3, "b", 2)]
    files.append(frame([(1, "a", 5)]), path)
    assert spark.read.parquet(path).count() == 4


def test_edges_by_density(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0.5, 0.01), (0, 2, 0.4, 0.02)], "i long, j long, w double, density double")
    files.write_edges(df, str(tmp_path / "e"))
    assert rows(spark.read.parquet(str(tmp_path / "e")).where("density = 0.02"), "i", "j", "w") == [(0, 2, 0.4)]


def test_matrix_in_parts(spark, tmp_path):
    """Rows are numbered through all parts, whatever the splits; without ``parts`` in each file."""
    (tmp_path / "m").mkdir()
    for k, text in enumerate(("1,2\n3,4\n", "", "5,6\n", "7,8\n9,10\n")):
        (tmp_path / "m" / f"part-{k:05d}.txt").write_text(text)
    got = files.read_matrix(spark, str(tmp_path / "m"), parts=True)
    assert sorted((r.i, r.j, r.w) for r in got.collect()) == [(k // 2, k % 2, k + 1.0) for k in range(10)]
    assert files.read_matrix(spark, str(tmp_path / "m")).agg({"i": "max"}).first()[0] == 1


def test_matrix_of_the_query_is_in_several_parts(spark, monkeypatch):
    """No task writes the whole matrix."""
    from checks import DATA

    from cortexa.plans import filed

    seen = []
    monkeypatch.setattr(filed, "_place", lambda s, place=filed._place: seen.append(place(s)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one part
    try:
        filed.matrix_splits(spark, DATA)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.text(seen[0]).select("_metadata.file_path").distinct().count() > 1
