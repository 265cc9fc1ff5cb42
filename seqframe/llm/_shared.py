"""Session helpers of the subpackage: shared folder, lineage cuts, table access."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of this machine in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="seqframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Stored intermediate results that one computation needs; they are deleted on leaving the context.

    What is read from them must have been written elsewhere by then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        return cut(df, label, self.path)

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or ``folder`` in it) and read it back.

    The files survive a lost executor, unlike a local checkpoint.  The shuffle files behind
    ``df`` are no longer needed afterwards, so the JVM is asked to drop them: otherwise they
    stay on disk until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # a task that got a frequent key writes several files, so that later stages can split its rows
    df.write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def named(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and back-ticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``names`` and all columns of ``df`` as one struct ``_row``, whatever the others are called."""
    return df.select(*names, F.struct(*named(df.columns)).alias("_row"))
