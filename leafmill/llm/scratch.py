"""Tables kept between jobs in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a folder in its warehouse, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tables between jobs need a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_between_jobs"
    return base.rstrip("/")


class Scratch:
    """Named tables of one operator call. Each is written once and read back, which cuts lineage.

    Tables that nothing reads any more are dropped by their operator; those that a result
    still reads go with the application: the file system deletes the folder on exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def _system(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        system, root = self._system(self.root)
        system.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The table and its number of rows, counted as it is written."""
        watch = Observation()
        kept = self.keep(df.observe(watch, F.count(F.lit(1)).alias("n")), name)
        return kept, watch.get["n"]

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            system, path = self._system(folder)
            system.delete(path, True)
