"""A Bloom filter of names as a small table: drops most rows that cannot join before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per name and bits set for each of them, inside one 64-bit block.
BITS, SET = 32, 5
# Blocks at most; the table is then 64 MB, enough for eight million names. A larger set of names is joined without a filter.
MOST_BLOCKS = 1 << 22


def _mask(key: list[Column]) -> Column:
    h, out = F.xxhash64(F.lit("bits"), *key), None
    for i in range(SET):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


class NameFilter:
    """Filter over the columns ``key`` of ``names``, sized by their number; ``blocks`` is 0 if it would be too large."""

    def __init__(self, names: DataFrame, key: list[str]):
        self.key = key
        n = names.count()
        self.blocks = -(-max(n, 1) * BITS // 64)
        self.blocks = self.blocks if self.blocks <= MOST_BLOCKS else 0
        if self.blocks:
            columns = [F.col(c) for c in key]
            self.table = names.select(self._block(columns).alias("_block"), _mask(columns).alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))

    def _block(self, columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.blocks))

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows whose key may be among the names."""
        if not self.blocks:
            return df
        columns = [F.col(c) for c in self.key]
        mask = _mask(columns)
        return (df.withColumn("_block", self._block(columns)).join(F.broadcast(self.table), "_block")
                .filter(F.col("_bits").bitwiseAND(mask) == mask).drop("_block", "_bits"))
