"""Resuming paid work: an append-only table of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ResumeStore:
    """Rows keyed by one column, appended in batches; broken lines of an interrupted write are left out on reading."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType):
        if key not in schema.fieldNames():
            raise ValueError(f"{key} is not in the schema")
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))

    def load(self) -> DataFrame:
        """All rows; of a key written twice one stays."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("mode", "DROPMALFORMED").json(self.path)
        return rows.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])

    def pending(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose key is not done."""
        return df.join(self.load().select(self.key), self.key, "left_anti")

    def append(self, df: DataFrame) -> None:
        """Add finished rows."""
        df.select(*self.schema.fieldNames()).write.mode("append").option("ignoreNullFields", "false").json(self.path)

    def n_done(self) -> int:
        return self.load().count()

    def clear(self) -> None:
        """Forget everything."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
