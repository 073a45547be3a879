"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where none is set and one machine does all the work."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="genomeloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Whether Spark deletes a query's shuffle files at the query's end instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession, tidy: bool = True) -> Iterator[None]:
    """What the queries run within shuffle leaves the disks when they end."""
    before = spark.conf.get(CLEANUP)
    try:
        spark.conf.set(CLEANUP, "true" if tidy else before)
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike a cached or locally checkpointed table, the result survives the loss
    of any executor, and later jobs start from files rather than from lineage.
    ``tidy``: what was shuffled for it leaves the disks once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with tidied(spark, tidy):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame) -> None:
    """Take the rows of a table that ``staged`` gave, and that nothing reads any more, from the disks."""
    files = df.inputFiles()
    if files:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
