"""Pieces that several operators share: session settings, lineage cuts, word rules, bounded id filters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.session import configure, cut_lineage, ensure_checkpoint_dir

# White space between words: space and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Size of an id filter in bits; the broadcast table has at most FILTER_BITS / 64 rows whatever the input.
FILTER_BITS = 1 << 22


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: small Arrow batches, so that long texts do not pile up in a worker."""
    configure(spark)
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
        "spark.sql.execution.pythonUDF.arrow.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a compressed table in the shared folder and read again; survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character unchanged; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def split_words(text: Column) -> Column:
    """All words of a whole text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def id_filter(ids: DataFrame, *key: Column) -> DataFrame:
    """Bit table of the keys in ``ids``: at most ``FILTER_BITS / 64`` rows, so it may always be broadcast."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    return (ids.select(slot.alias("slot"))
            .groupBy(F.shiftright("slot", 6).alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("_bits")))


def flag_ids(df: DataFrame, bits: DataFrame, *key: Column) -> DataFrame:
    """Adds ``_maybe``: false means that the key is certainly not in the filter, true that it may be."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    return (df.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
            .join(F.broadcast(bits), "_word", "left")
            .withColumn("_maybe", F.coalesce(F.expr("(shiftright(_bits, cast(_slot & 63 as int)) & 1) = 1"), F.lit(False)))
            .drop("_slot", "_word", "_bits"))


def has_rows(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) > 0


__all__ = ["SPACE", "WORD", "UPPER", "LOWER", "prepare", "scratch", "stored", "lower_ascii", "split_words", "id_filter", "flag_ids", "has_rows", "cut_lineage"]
