"""Small helpers of the llm operators."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_per_key(df: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """One row for each ``key``; of rows delivered again, the one with the latest ``late`` (ties: the largest row).

    The pick is a hash aggregate with map-side combination, so a key that is delivered very often is reduced before the
    shuffle. Rows without a key are dropped, as no result could name them.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.where(F.col(key).isNotNull()).dropDuplicates([key])
    order = ([late] if late else []) + [c for c in rest if c != late]
    best = F.max(F.struct(*[F.col(c) for c in order])).alias("_row")
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


#: Bits of a filter of hashes: 2**27, a broadcast of 16 MB whatever the size of the data. Of hashes that were not asked for, one in
#: 135 passes at a million that were, and one in 14 at ten million.
FILTER_BITS = 27


def hash_filter(hashes: DataFrame, column: str) -> Broadcast:
    """The last ``FILTER_BITS`` bits of 64-bit hashes as a bitmap that is sent to all executors (see ``passes``)."""
    h = F.col(column)
    word, bit = F.shiftright(h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.where(h.isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) may be among those of the filter: all that are, and few others."""
    place = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
