"""Tables kept by genome: bucketed and sorted by ome, so that work by genome, contig or gene needs no exchange.

A stored table is a folder of Parquet files, of which each holds whole genomes, and a small table that says how
they were dealt out. Readers hand this on to the optimizer, so aggregates, windows and joins whose keys begin with
the genome run on the files as they lie. Results that grow genome by genome are committed as a folder for each:
a job that is started again replaces whole genomes and ends with the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from genomeloom.sources.shared import shared_dir, tidied


def _register(spark: SparkSession, path: str, schema: str, by: str, order: list[str], buckets: int) -> DataFrame:
    name = f"genomes_{uuid.uuid4().hex}"
    held = ", ".join(f"`{c}`" for c in order)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{by}`) SORTED BY ({held}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_store(df: DataFrame, path: str, order: list[str], buckets: int, by: str = "ome", tidy: bool = False) -> DataFrame:
    """Write ``df`` into the new folder ``path``, a file for each of ``buckets`` of genomes, sorted by genome and ``order``, and read it back.

    ``buckets`` sets the size of a file: some 100 to 1000 MB each at the size that the table will have. Every table
    that is to be joined by genome without an exchange takes the same number. ``tidy`` as in ``staged``.
    """
    spark = df.sparkSession
    order = [by, *(c for c in order if c != by)]
    layout = [(df.schema.toDDL(), by, ",".join(order), buckets)]
    name = f"genomes_{uuid.uuid4().hex}"
    # one exchange now, one file a bucket
    with tidied(spark, tidy):
        df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(*order).option("path", f"{path}/data").saveAsTable(name)
    spark.createDataFrame(layout, "columns string, by string, sorted string, buckets int").coalesce(1).write.parquet(f"{path}/layout")
    return spark.table(name)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_store``, with its bucketing, in any session."""
    layout = spark.read.parquet(f"{path}/layout").first()
    return _register(spark, f"{path}/data", layout["columns"], layout["by"], layout["sorted"].split(","), layout["buckets"])


def stored(df: DataFrame, name: str, order: list[str], by: str = "ome", buckets: int | None = None, tidy: bool = False) -> DataFrame:
    """``df`` stored by genome in the shared folder; as many buckets as the session has shuffle partitions unless said."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_store(df, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", order, n, by, tidy)


def commit_genomes(df: DataFrame, path: str, by: str = "ome") -> None:
    """Add ``df`` to a table of one folder a genome: a genome's folder is replaced whole, others stay, so two runs equal one."""
    df.repartition(by).sortWithinPartitions(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``commit_genomes``; ``schema`` has all columns, the genome's too, and sets their order."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.select(*StructType.fromDDL(schema).names)
