"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset, in local mode alone."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cortexa-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, which may be any that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    place, files = _path(spark, path)
    files.delete(place, True)


def present(spark: SparkSession, path: str) -> bool:
    place, files = _path(spark, path)
    return files.exists(place)


def move(spark: SparkSession, path: str, target: str) -> None:
    place, files = _path(spark, path)
    if not files.rename(place, _path(spark, target)[0]):
        raise OSError(f"{path} cannot be moved to {target}")


def scratch_folder(spark: SparkSession) -> str:
    """A folder for this session's tables below the shared one, which is deleted when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/cortexa-{spark.sparkContext.applicationId}"
    place, files = _path(spark, folder)
    if not files.exists(place):
        files.mkdirs(place)
        files.deleteOnExit(place)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table, which is more compact than a checkpoint and goes with the session."""
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Parquet tables of an iteration, which are deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            discard(self.spark, self.paths.pop(id(table))[1])

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but these."""
        names = {id(x) for x in kept}
        self.drop(*(table for key, (table, _) in list(self.paths.items()) if key not in names))
