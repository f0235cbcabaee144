"""A small keyed table that each micro-batch replaces as a whole.

Batch N reads the version of batch N-1 and writes its own, so running batch N a second
time after a failure gives the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keep: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/version={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        """The table as batch ``batch_id`` finds it; empty for the first batch."""
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.at(batch_id - 1)

    def at(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(batch_id))

    def write(self, table: DataFrame, batch_id: int) -> DataFrame:
        table.write.mode("overwrite").parquet(self._folder(batch_id))
        self._forget(batch_id - self.keep)
        return self.at(batch_id)

    def _forget(self, batch_id: int) -> None:
        """Drop a version no restart can ask for any more."""
        if batch_id < 0:
            return
        jvm = self.spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(self._folder(batch_id))
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
