"""Connected components of a link table by alternating stars.

Links always point from the larger to the smaller end. One round sends every
link to the smallest neighbour of its lower end, then to the smallest
neighbour of its upper end; the number of rounds grows with the logarithm of
the longest chain. Minima are combined before the shuffle, so a hub costs one
row per task, and no group is ever collected. Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.session import staged


def _is_stars(links: DataFrame) -> bool:
    """Whether every upper end has one link and no lower end is an upper end."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionAll(
        links.select(F.col("b"), F.lit(0), F.lit(1))
    )
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") > 0)))
    return bad.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link and is not itself the root.

    ``links`` has columns a and b of one orderable type; the root is the
    smallest node of the component. Loops and nulls are ignored; an empty
    table gives an empty table.
    """
    flat = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(flat.distinct(), "links")
    while not _is_stars(now):
        lowest = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        upper = now.join(lowest, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        least = upper.groupBy("a").agg(F.min("b").alias("m"))
        lower = upper.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(least.select("a", F.col("m").alias("b")).unionAll(lower).distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
