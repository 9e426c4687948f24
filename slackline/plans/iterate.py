"""Loops over DataFrames whose state is cut by reliable checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """Spark's folder for checkpoints, in spark.checkpoint.dir; a folder of its own only where that is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        known = sc.getConf().get("spark.checkpoint.dir")
        if not known and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="slackline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed and stored in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


class Store:
    """Compressed tables in the shared folder that go by name, for loops whose checkpoints would not fit a disk together."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.names = spark, f"{shared(spark)}/{name}-{uuid.uuid4().hex}", []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, names: list[str]) -> None:
        """Deletes tables that no later plan reads; Spark clears a shuffle's files once nothing refers to it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            self.names.remove(name)
        gc.collect()
        jvm.System.gc()
