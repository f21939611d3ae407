"""A blocked Bloom filter: eight bits of one 256-bit block to a key, built in a distributed aggregation and probed on
Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed odd multipliers, one to each 32-bit word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
BITS_A_KEY = 12
#: The broadcast filter never takes more; with more keys it lets more false hits through to the exact join.
MAX_BYTES = 32 << 20


def build(keys: DataFrame, column: str, expected: int, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter of 64-bit hashes: an array of blocks by eight 32-bit words."""
    blocks = max(1, min(max_bytes // 32, expected * BITS_A_KEY // 256 + 1))
    h = F.col(column)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))

    def bit(k: int) -> Column:
        return F.shiftright(low * F.lit(SALTS[k]), 26).bitwiseAND(F.lit(31)).cast("int")

    halves = [F.expr("shiftleft(1L, b0)")]
    shifted = keys.select(F.pmod(F.shiftrightunsigned(h, 31), F.lit(blocks)).alias("block"), *[bit(k).alias(f"b{k}") for k in range(8)])
    halves = [F.expr(f"bit_or(shiftleft(1L, b{k}) | shiftleft(1L, b{k + 1} + 32))").alias(f"w{k // 2}") for k in range(0, 8, 2)]
    out = np.zeros((blocks, 4), np.int64)
    for r in shifted.groupBy("block").agg(*halves).toLocalIterator():  # max_bytes / 32 rows at most
        out[r[0]] = r[1:]
    return out.view(np.uint32)


def probe(blocks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    u = h.view(np.uint64)
    own = blocks[(u >> np.uint64(31)) % np.uint64(len(blocks))]
    low = u & np.uint64(0x7FFFFFFF)
    hit = np.ones(len(h), bool)
    for k, salt in enumerate(SALTS):
        at = ((low * np.uint64(salt)) >> np.uint64(26)) & np.uint64(31)
        hit &= (own[:, k] >> at.astype(np.uint32)) & np.uint32(1) == 1
    return hit


def membership(keys: DataFrame, expected: int, max_bytes: int = MAX_BYTES):
    """A function of a column of 64-bit hashes that tells which may be among `keys` (h); the filter is broadcast."""
    sieve = keys.sparkSession.sparkContext.broadcast(build(keys, "h", expected, max_bytes))

    @F.pandas_udf("boolean")
    def possible(h):
        import pandas as pd

        return pd.Series(probe(sieve.value, np.ascontiguousarray(h.to_numpy(np.int64))))

    return possible
