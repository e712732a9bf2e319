"""Tables that iterations write to the folder all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def tasks(df: DataFrame, mb: int) -> int:
    """How many tasks give each `mb` MB of the files and local rows that df reads, so that a task's share does not grow with the input."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [str(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return max(1, -(-sum(int(x) for x in sizes if int(x) < 1 << 60) // (mb << 20)))


class Space:
    """Named tables under spark.checkpoint.dir (a temporary folder where it is unset and Spark is local)."""

    def __init__(self, spark: SparkSession, name: str):
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            if not _OWN:
                _OWN.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
            where = _OWN[0]
        self.spark, self.root = spark, f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
