"""Bloom filters over 64-bit hashes: built by an aggregate, tested with numpy inside tasks.

Two bit positions come from the two halves of a hash. A filter has at most MAX_BITS bits (32 MB), which bounds
what is sent to the driver and to every task; more keys than that suits raise the share of false positives,
and every use here is followed by an exact step.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BITS = 1 << 28


def bits_for(keys: int, per_key: int = 24) -> int:
    return int(min(MAX_BITS, max(1 << 16, 1 << (max(1, keys) * per_key - 1).bit_length())))


def build(df: DataFrame, hash_col: str, bits: int) -> np.ndarray:
    """The filter's words as unsigned 64-bit numbers."""
    h = F.col(hash_col)
    low, high = h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))
    places = df.select(F.explode(F.array(low, high)).alias("p"))
    words = places.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("v")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    if words.num_rows:
        out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the hashes that the filter may hold."""
    bits = np.uint64(len(words) * 64 - 1)
    low = hashes & bits
    out = (words[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0
    kept = np.flatnonzero(out)
    high = (hashes[kept] >> np.uint64(32)) & bits
    out[kept] = (words[high >> np.uint64(6)] >> (high & np.uint64(63))) & np.uint64(1) > 0
    return out
