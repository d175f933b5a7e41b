"""Session helpers that the operators share."""

from __future__ import annotations

import logging
import os
import re
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "medloom.shipped"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder, opened by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can
    import it whatever their working folder is."""
    sc = spark.sparkContext
    if getattr(sc, "_medloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="medloom"), "medloom_ship.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(target)
    sc._medloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, the cluster's own setting. Only a local master may go
    without one, as in tests: it gets a temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="medloom_checkpoint"))
    return sc.getCheckpointDir()


@contextmanager
def timed(name: str):
    """Logs the seconds that a block takes. Only actions take long: a plan is made at once."""
    start = time.perf_counter()
    try:
        yield
    finally:
        logging.getLogger("medloom").debug("%s took %.3f s", name, time.perf_counter() - start)


def kept(frame: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder: computed once, and it outlives lost executors."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared checkpoint folder and read again: they cut lineage, outlive lost
    executors, and go at the end of the block. What leaves the block must not depend on them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables = 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        delete(self.spark, self.folder)

    def keep(self, frame: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        frame.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, number: int) -> None:
        """Remove the table kept as the number-th, once nothing reads it any more."""
        delete(self.spark, f"{self.folder}/{number}")
