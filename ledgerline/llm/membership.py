"""A bounded filter for "is this key perhaps among those": a bitmap over hash slots, built by Spark and broadcast.

Its size is fixed (``SLOTS`` bits, 2 MB). Keys it passes wrongly cost work in the exact join that follows, never results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 24


def slot(key: Column) -> Column:
    """The slot of a key; nulls share one."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(SLOTS))


def slot_bits(slots: DataFrame) -> np.ndarray:
    """Packed bits of the slots in column ``slot``; at most 512 pieces of 4 KB come to the driver."""
    from_one = F.col("slot") + 1  # bitmap functions number bits from 1
    pieces = slots.groupBy(F.bitmap_bucket_number(from_one).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(from_one)).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in pieces:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def members(bits: np.ndarray) -> np.ndarray:
    """A truth value for every slot."""
    return np.unpackbits(bits, bitorder="little").view(bool)


def perhaps(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits ``df`` into rows whose key is surely not in ``keys`` (column ``key``) and all others."""
    bits = df.sparkSession.sparkContext.broadcast(slot_bits(keys.select(slot(F.col("key")).alias("slot"))))

    @F.pandas_udf("boolean")
    def within(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy(np.int64)
        return pd.Series((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    marked = within(slot(key))
    return df.filter(~marked), df.filter(marked)
