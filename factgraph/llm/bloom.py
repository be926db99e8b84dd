"""Blocked Bloom filters in DataFrame functions.

A block is four 64-bit words. A key's first hash picks the block, and six-bit
pieces of its second hash set two bits in every word, so that a probe touches
one block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, BLOCK_BITS, WORDS = 16, 256, 4
MAX_BLOCKS = 1 << 14  # 512 KB of words, as each row may carry them; more keys make the filter denser, not larger


def blocks_for(n_keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-n_keys * BITS_PER_KEY // BLOCK_BITS)))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _mask(h: Column, word: int) -> Column:
    def one(at: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(63).cast("int"))

    return one(12 * word).bitwiseOR(one(12 * word + 6))


def build(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row with the dense array of words; its size depends on n_blocks alone."""
    h = F.xxhash64(F.col(key), F.lit(1))
    filled = keys.groupBy(_block(F.col(key), n_blocks).alias("b")).agg(*[F.bit_or(_mask(h, w)).alias(f"w{w}") for w in range(WORDS)])
    every = keys.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("b"))
    words = F.array(*[F.coalesce(F.col(f"w{w}"), F.lit(0)) for w in range(WORDS)])
    return (every.join(filled, "b", "left").agg(F.sort_array(F.collect_list(F.struct("b", words.alias("w")))).alias("x"))
            .select(F.flatten(F.col("x.w")).alias("words")))


def may_contain(words: Column, key: Column, n_blocks: int) -> Column:
    h, at = F.xxhash64(key, F.lit(1)), _block(key, n_blocks) * WORDS
    out = F.lit(True)
    for w in range(WORDS):
        out = out & (F.get(words, at + w).bitwiseAND(_mask(h, w)) == _mask(h, w))
    return out
