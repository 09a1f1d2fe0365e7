"""Where a run's tables are: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends, not when the driver's garbage is collected.
SHORT_LIVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine a temporary folder where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kinroster-")
        atexit.register(shutil.rmtree, urlparse(where).path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where


class Store:
    """The tables of one run.

    A table is written when it is first asked for and then read: whatever builds on it is planned
    over a scan, so plans stay as small as the model itself, and a lost executor costs nothing.
    The shuffle files that made it go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        where = f"{self.path}/{name}"
        before = self.spark.conf.get(SHORT_LIVED, None)
        self.spark.conf.set(SHORT_LIVED, "true")
        try:
            df.write.mode("overwrite").parquet(where)
        finally:
            self.spark.conf.unset(SHORT_LIVED) if before is None else self.spark.conf.set(SHORT_LIVED, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self) -> None:
        """Delete the run's tables."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
