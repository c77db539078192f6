"""Tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: With it, Spark removes a query's shuffle files when the query has ended; what was written doesn't need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir()


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # for this write only: other plans may be run again and then need their files
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: what builds on it has a short plan, and a lost executor costs no recomputation."""
    return _written(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def at_path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path and the path in it, as Hadoop has them."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = at_path(spark, path)
    return system.exists(there)


def delete(spark: SparkSession, path: str) -> None:
    system, there = at_path(spark, path)
    system.delete(there, True)


class Scratch:
    """The intermediate tables of one computation, in one folder of the shared folder; drop() deletes those that nothing needs any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As written(); a name may be used again."""
        self.made += 1
        path = f"{self.folder}/{name}-{self.made}"
        self.paths.setdefault(name, []).append(path)
        return _written(df, path)

    def drop(self, *names: str, last: int = 0) -> None:
        """Deletes the tables of these names, but for the last ones of each."""
        for name in names:
            paths = self.paths.get(name, [])
            for path in paths[: len(paths) - last]:
                delete(self.spark, path)
            self.paths[name] = paths[len(paths) - last :]
