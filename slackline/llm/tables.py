"""Reading tables and handing results between jobs."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.shipping import ship

#: Bytes of an Arrow batch for Python; whole rows, so a longer text is a batch of its own.
BATCH_BYTES = 4 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(docs: DataFrame) -> DataFrame:
    """Whole rows for an Arrow function, in batches of bounded size."""
    spark = docs.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text for an Arrow function, in batches of bounded size."""
    return rows_of(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of its file system: the default one where it names none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of its own only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="slackline-")
        sc.setCheckpointDir(known)
    return qualified(spark, known).rstrip("/")


def by_part(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Whole groups of rows that are sorted by columns of whole numbers: (the number, or a tuple of them, and the rows)."""
    held: list[pa.RecordBatch] = []
    now: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
        change = np.any([k[1:] != k[:-1] for k in keys], 0)
        edge = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            key = tuple(int(k[a]) for k in keys)
            if held and now != key:
                yield now[0] if len(columns) == 1 else now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now[0] if len(columns) == 1 else now, pa.Table.from_batches(held)


class Scratch:
    """Tables written to the shared folder: they outlive executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads, and lets Spark clear the shuffles behind them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
        for _ in range(2):  # Spark removes a shuffle's files once nothing refers to it
            gc.collect()
            jvm.System.gc()
            time.sleep(0.3)
