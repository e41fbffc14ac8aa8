from pyspark.sql import functions as F

from cortexa.plans.steps import Step, run_steps
from cortexa.streaming import metrics


def test_steps_are_skipped_blocked_and_run_again(spark, tmp_path):
    def broken(spark, _):
        raise ValueError("no input")

    steps = [
        Step("a", lambda s, _: s.range(5)),
        Step("b", lambda s, t: t["a"].where("id > 1"), ("a",)),
        Step("c", broken),
        Step("d", lambda s, t: t["c"], ("c",)),
        Step("e", lambda s, t: t["b"].agg(F.sum("id").alias("n")), ("b",)),
    ]
    status = lambda df: [(r.step, r.status, r.rows) for r in df.collect()]
    assert status(run_steps(spark, str(tmp_path), steps)) == [("a", "done", 5), ("b", "done", 3), ("c", "failed", None), ("d", "blocked", None), ("e", "done", 1)]
    assert [s for _, s, _ in status(run_steps(spark, str(tmp_path), steps))] == ["skipped", "skipped", "failed", "blocked", "skipped"]
    assert status(run_steps(spark, str(tmp_path), steps[:1], again=True)) == [("a", "done", 5)]


def test_retention_follows_new_files(spark, tmp_path):
    frames = lambda *rows: spark.createDataFrame(rows, "subject int, at string, fd double").withColumn("at", F.col("at").cast("timestamp"))
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(*rows):
        frames(*rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema("subject int, at timestamp, fd double").parquet(source)
        kept = metrics.frame_retention(stream, ["subject"], "at", F.col("fd") < 0.3)
        metrics.keep_updated(kept, table, ["subject", "start"], state).start().awaitTermination()

    arrive((1, "2024-01-01 10:00:00", 0.1), (1, "2024-01-01 11:00:00", 0.5), (2, "2024-01-01 10:00:00", None))
    arrive((1, "2024-01-01 12:00:00", 0.2), (1, "2024-01-02 10:00:00", 0.2))
    got = sorted((r.subject, r.start.day, r.n_frames, r.n_kept) for r in spark.read.parquet(table).collect())
    assert got == [(1, 1, 3, 2), (1, 2, 1, 1), (2, 1, 1, 0)]


def test_subjects_are_made_once_and_fail_alone(spark, tmp_path):
    import pandas as pd

    from cortexa.plans import steps

    path, broken = str(tmp_path / "out"), {"c"}
    rows = spark.createDataFrame([(s, float(k)) for s in "abcd" for k in range(5)], "subject string, v double")

    def make(missing, bad):
        def mean(group):
            if group.subject.iloc[0] in bad:
                raise ValueError("no signal")
            return pd.DataFrame({"subject": group.subject.iloc[:1], "mean": [group.v.mean()]})

        return steps.by_subject(rows.join(missing, "subject"), "subject", mean, "subject string, mean double")

    run = lambda wanted, bad: {r.subject: (r.status, r.error) for r in steps.run_subjects(spark, path, "subject", wanted, lambda m: make(m, bad)).collect()}
    three = rows.where("subject < 'd'")
    assert run(three, broken) == {"a": ("done", None), "b": ("done", None), "c": ("failed", "ValueError: no signal")}
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert {p.parent.name for p in first} == {"subject=a", "subject=b"}
    assert run(rows, set()) == {"a": ("skipped", None), "b": ("skipped", None), "c": ("done", None), "d": ("done", None)}
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert first.items() <= after.items() and {p.parent.name for p in after.keys() - first.keys()} == {"subject=c", "subject=d"}
    assert sorted((r.subject, r["mean"]) for r in spark.read.parquet(path).collect()) == [(s, 2.0) for s in "abcd"]
    assert {s for s, _ in run(rows, set()).values()} == {"skipped"}
