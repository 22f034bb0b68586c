"""Results of streams as appended Parquet: every batch writes a folder of its own, plain aggregates read the current rows.

A batch delivered again replaces its own folder, so repeating it changes nothing; what a batch writes is in proportion to the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_delta(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def deltas(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows written so far, with their batch; without any, an empty frame of ``schema``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if schema is not None and not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.parquet(path)


def current(rows: DataFrame, keys) -> DataFrame:
    """The newest row of every key: one aggregation with partial results, whatever share of the rows a key has."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def compact(spark: SparkSession, path: str, keys, target: str) -> None:
    """The current rows as the one batch of a new folder."""
    write_delta(current(deltas(spark, path), keys), target, 0)
