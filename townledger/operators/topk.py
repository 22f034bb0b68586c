"""Ranked picks per group that stay exact when one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_group(df: DataFrame, group, order, k: int, salt_by=None, salts: int = SALTS, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group in ``order`` (which must end in a unique key).

    With ``salt_by`` a first pick runs on slices of each group, so that no task ever sorts a
    whole hot group; the second pick sees at most ``salts * k`` rows per group.
    """
    group = list(group)
    if salt_by is not None:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts))
        sliced = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", part).withColumn("_pick", F.row_number().over(sliced))
              .filter(F.col("_pick") <= k).drop("_salt", "_pick"))
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key; the planner prunes to one row per key before the shuffle."""
    return top_per_group(df, keys, order, 1, rank="_first").drop("_first")


def previous_value(df: DataFrame, keys, seq: str, chunk: Column, value: str, name: str) -> DataFrame:
    """The value of the preceding row per key in ``seq`` order, without sorting a hot key in one task.

    ``chunk`` must not decrease with ``seq``. Inside a chunk a window finds the preceding row; the
    first row of a chunk takes the last value of the chunk before it, from one row per chunk.
    """
    keys = list(keys)
    df = df.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    marked = df.withColumn("_pos", F.row_number().over(inner)).withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    ends = df.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(seq)).alias("_end"))
    carried = ends.select(*keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    joined = marked.join(carried, keys + ["_chunk"])
    prev = F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return (joined.withColumn("_prev", prev)
            .withColumn(name, F.col("_prev")["v"]).withColumn(f"has_{name}", F.col("_prev").isNotNull())
            .drop("_chunk", "_pos", "_lag", "_carry", "_prev"))
