"""Durable intermediate tables.

An operator that needs a result more than once, or that iterates, writes it as
parquet below the folder the session names in ``spark.checkpoint.dir`` (shared by
all executors, so it survives the loss of any of them) and reads it back, which
also cuts the lineage.  A folder of our own is used only where the setting is
absent, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one run of an operator; ``drop`` removes one that was superseded."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it read from the written files."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        if self.count == 1:  # results are read from these tables, so they go when the application ends
            jvm = self.spark.sparkContext._jvm
            base = jvm.org.apache.hadoop.fs.Path(self.base)
            base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(base)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that ``save`` returned."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
