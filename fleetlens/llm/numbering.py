"""Gapless numbers for the rows of a table, independent of how it is stored.

Rows are put into hash buckets of a few tens of thousands by their whole
identity; a number is the bucket's offset plus the place inside the bucket.
Equal rows are counted before the shuffle and unfolded after numbering, so
copies of one row never meet in one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 20_000


def _identity(columns: list[str]) -> Column:
    # The hash takes null as nothing; the separate flag keeps (null, 1) and (1, null) apart.
    return F.xxhash64(*[c for name in columns for c in (F.col(name), F.col(name).isNull())])


def numbered(rows: DataFrame, into: str, by: list[str], within: list[str] | None = None, total: int | None = None) -> DataFrame:
    """``rows`` (all columns hashable) with a number from 0 in ``into``, gapless within each value of ``within``.

    The order is by hash bucket, then by the columns ``by``, then by all others. ``total`` saves the count. Two small
    tables are joined on the way: rows per bucket and running sums over them.
    """
    keys = list(within or [])
    names = rows.columns
    order = [*by, *[c for c in names if c not in by]]
    if total is None:
        total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    counted = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    placed = counted.withColumn("_bucket", F.pmod(_identity(names), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    # Bucket sizes: one row per 20 000 rows. Runs of 4 096 buckets are summed first, so no window holds them all.
    run = sizes.withColumn("_run", F.floor(F.col("_bucket") / 4096).cast("int"))
    runs = run.groupBy(*keys, "_run").agg(F.sum("_size").alias("_size"))

    def before(order: str, *part: Column | str) -> Column:
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(window), F.lit(0))

    base = runs.select(*keys, "_run", before("_run", *(keys or [F.lit(0)])).alias("_base"))
    same = lambda a, b, on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    inner = run.withColumn("_inner", before("_bucket", *keys, "_run"))
    offsets = inner.alias("i").join(base.alias("b"), same("i", "b", [*keys, "_run"])).select(
        *[F.col(f"i.{c}").alias(c) for c in [*keys, "_bucket"]], (F.col("_inner") + F.col("_base")).alias("_offset")
    )
    window = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0)))
    joined = local.alias("l").join(offsets.alias("o"), same("l", "o", [*keys, "_bucket"])).select(
        *[F.col(f"l.{c}").alias(c) for c in names], (F.col("_offset") + F.col("_before")).alias("_first"), "_n"
    )
    unfolded = joined.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return unfolded.select(*names, (F.col("_first") + F.col("_copy")).alias(into))
