"""Durable intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A step that is used twice is written there as Parquet and read back: that cuts lineage, survives
the loss of executors and, unlike an in-memory cache, needs no executor storage.  Only where the
setting is absent (single-machine tests) a temporary folder of the driver is used instead.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a temporary folder of a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and executors share")
    if not _local_folder:
        folder = tempfile.mkdtemp(prefix="loom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folder.append("file://" + folder)
    return _local_folder[0]


class Scratch:
    """A folder of intermediate tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, release: bool = True) -> DataFrame:
        """Write ``df`` and return it read back.

        ``release`` frees the shuffle files of finished steps, which costs a full collection in the
        driver; loops over small tables leave it out.
        """
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        del df
        if release:
            # The context cleaner frees shuffle files once the driver has let go of their owners; Spark
            # holds on to the latest plan it ran, so a trivial one has to follow.
            self.spark.range(1).collect()
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
