"""Reproducible shuffle and sharding by a Feistel permutation of row numbers.

Rows get gapless global numbers; a keyed Feistel network permutes the smallest
even-bit range that holds them, and numbers that fall outside walk on through
the permutation until they are inside, which is again a permutation of the
rows. The permuted number is dealt out in turn: shard = p mod shards,
slot = p div shards. Shard sizes differ by one row at most whatever the texts,
sources or copies are, and place, shard and slot of any row number can be
computed, also backwards, without the data.

Defined results: null keys and texts are values like others; equal rows are
interchangeable and get different slots; an empty table gives no rows. Only
the key and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.numbering import numbered

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, seed: int, r: int, half: int) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) & np.uint64((1 << half) - 1)


def _network(x: np.ndarray, seed: int, half: int, back: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, seed, r, half), left
        else:
            left, right = right, left ^ _round(right, seed, r, half)
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1, or its inverse."""
    half = _half_bits(n)
    out = _network(np.asarray(numbers).astype(np.uint64), seed, half, back)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = _network(out[far], seed, half, back)
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, row_number, place, shard, slot): one row per input row."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).alias(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    n = docs.count()

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    out = numbered(rows, "row_number", [key, "size", "text_crc32"], total=n).withColumn("place", place("row_number"))
    return out.select(
        key, "size", "text_crc32", "row_number", "place", F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
    )
