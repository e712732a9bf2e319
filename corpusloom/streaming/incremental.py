"""Files and snapshots as they arrive. The batch scans have no incremental form of their own; these two keep an inventory and the latest snapshots up to date.

State is one small row for each value or slug, combined before the shuffle; sinks are the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract


def watch(spark: SparkSession, root: str, glob: str = "*.{ts,tsx,js,jsx}", files_per_trigger: int = 1000) -> DataFrame:
    """path, text of files as they appear under root."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def literal_counts(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """value, n over all files so far (update or complete mode)."""
    return extract.occurrences(files, pattern, {"value": group}).groupBy("value").agg(F.count("*").alias("n"))


def latest(snapshots: DataFrame, by: str, order: str) -> DataFrame:
    """The latest row of each key so far (update or complete mode), however late it comes: state is one row a key and stays, as any key may come again."""
    rest = [c for c in snapshots.columns if c != by]
    picked = snapshots.groupBy(by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return picked.select(by, *(F.col(f"r.`{c}`").alias(c) for c in rest))
