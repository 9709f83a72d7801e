"""Tables that are kept between the jobs of one operator, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one has a folder in its warehouse, a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tables between jobs need a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kept"
    return base.rstrip("/")


def file_system(spark: SparkSession, folder: str):
    """The file system of a path, and the path as it names it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Kept:
    """A folder of tables: each is written once and read back, so no job is done twice. It goes with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(path)
        system, root = file_system(self.spark, self.root)
        system.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)
