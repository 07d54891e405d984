"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType

# A lookup side is broadcast only when it is shown to have at most this many rows and bytes.
LOOKUP_ROWS = 100_000
LOOKUP_BYTES = 64 << 20
# A key is hot when it owns more than 1/1000 of the rows: fewer than 1000 exist.
HOT_SHARE = 1000


def bounded_local(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``limit`` rows and LOOKUP_BYTES, else None."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit or rows.nbytes > LOOKUP_BYTES:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with a per-key table.

    The size of ``small`` is checked first. Within the bound it is broadcast
    and ``big`` is not shuffled; beyond it the skew-safe shuffle join is used.
    A stream is joined with the table as it is: Spark reads it anew in every
    batch and picks the strategy by its size.
    """
    if big.isStreaming:
        return big.join(small, on, how)
    small, local = checked(small)
    return lookup_checked(big, small, local, on, how)


def checked(small: DataFrame) -> tuple[DataFrame, bool]:
    """``small`` with the outcome of its size check; local when within the bound."""
    local = bounded_local(small)
    return (small, False) if local is None else (local, True)


def measured(small: DataFrame, column: str) -> tuple[DataFrame, bool, int]:
    """``checked`` with the largest value of a count column; 0 for an empty table."""
    rows = small.limit(LOOKUP_ROWS + 1).toArrow()
    if rows.num_rows <= LOOKUP_ROWS and rows.nbytes <= LOOKUP_BYTES:
        return small.sparkSession.createDataFrame(rows, small.schema), True, max(rows.column(column).to_pylist(), default=0)
    return small, False, small.agg(F.max(column)).first()[0]


def lookup_checked(big: DataFrame, small: DataFrame, local: bool, on: list[str], how: str = "inner") -> DataFrame:
    """``lookup_join`` for a side that was checked before."""
    return big.join(F.broadcast(small), on, how) if local else skew_join(big, small, on, how)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the values of a one-row aggregate to every row, as literals."""
    row = one_row.first()
    plain = {f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema if not isinstance(f.dataType, (ArrayType, MapType))}
    nested = {
        f.name: F.from_json(F.lit(json.dumps(row.asDict(True)[f.name])), f.dataType)
        for f in one_row.schema
        if isinstance(f.dataType, (ArrayType, MapType))
    }
    return df.withColumns({**plain, **nested})


def required(value: str, what: str, key: str) -> Column:
    """``value``, or an error that names the key where a left join found nothing."""
    complain = F.raise_error(F.concat(F.lit(f"no {what} for "), F.lit(key), F.lit(" "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.when(F.col(value).isNull(), complain).otherwise(F.col(value))


def skew_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Shuffle join in which hot keys of ``big`` never meet in one task.

    ``small`` has one row per key. Keys holding over 1/HOT_SHARE of ``big``
    are found by a pre-aggregated count; their rows of ``small`` are broadcast
    (fewer than HOT_SHARE rows by arithmetic), all others are shuffled.
    """
    counts = big.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    hot = bounded_local(counts.where(F.col("_rows") * HOT_SHARE > F.lit(total)).select(*on), HOT_SHARE)
    if not hot.take(1):
        return big.join(small, on, how)
    hot_small = small.join(F.broadcast(hot), on, "left_semi")
    hot_big = big.join(F.broadcast(hot), on, "left_semi")
    cold_big = big.join(F.broadcast(hot), on, "left_anti")
    return hot_big.join(F.broadcast(hot_small), on, how).unionByName(cold_big.join(small, on, how))
