"""Exact order statistics, prefix samples and cumulative counts without a global sort.

Every operator here works on two levels. A fixed monotone bucket function
splits the order into buckets; counting rows per bucket (combined map-side)
gives a small table whose running sums say which bucket holds a wanted rank.
Only the rows of those buckets are then looked at one by one. No group, hot or
not, is ever sorted as a whole, and results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.expressions import hash_bucket, value_bucket, value_key
from fleetlens.operators.joins import lookup_checked, lookup_join, measured, with_scalars
from fleetlens.session import staged

# Rows of a hit bucket that are ordered as they are; a fuller one is cut finer first.
BUCKET_ROWS = 1 << 16
# Bits of the value key that a finer bucket leaves open: a bucket has at most 2**16 of the first kind, one of those
# 2**15 of the second, and one of these at most 2**13 distinct values.
FINER = (27, 12)


def _running(coarse: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """Adds ``<m>_before`` (sum over earlier buckets) and the group's row total."""
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return coarse.select(
        "*",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_before") for m in measures],
        F.sum("n").over(whole).alias("total"),
    )


def prefix_cuts(
    rows: DataFrame,
    group: list[str],
    order: str,
    cuts: dict[str, Callable[[Column], Column]] | DataFrame,
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Where the first ``need`` rows of each group end, in hash order.

    ``order`` names an md5 text that is unique in its group. ``cuts`` maps a
    label to the wanted size as a function of the group's row count, or is a
    table with some of the group's columns and ``wanted``, an array of
    (cut, need). The result has one row per (group, cut): ``need``, ``cutoff`` (the last hash
    inside) and the sum of every measure over the prefix. A cut of size zero
    or beyond the group has no row.
    """
    measures = measures or {}
    names = ["n", *measures]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    keyed = rows.select(
        *group,
        F.col(order).alias("h"),
        hash_bucket(order, cores).alias("bucket"),
        F.lit(1).cast("long").alias("n"),
        *[c.cast("long").alias(m) for m, c in measures.items()],
    )
    coarse = keyed.groupBy(*group, "bucket").agg(*[F.sum(m).alias(m) for m in names])
    running = _running(coarse, group, names)
    if isinstance(cuts, DataFrame):
        shared = [c for c in cuts.columns if c != "wanted"]
        running = lookup_join(running, cuts, shared) if shared else with_scalars(running, cuts)
    else:
        sizes = [F.struct(F.lit(k).alias("cut"), size(F.col("total")).cast("long").alias("need")) for k, size in cuts.items()]
        running = running.withColumn("wanted", F.array(*sizes))
    inside = F.filter(
        "wanted", lambda w: (w["need"] > F.col("n_before")) & (w["need"] <= F.col("n_before") + F.col("n"))
    )
    hits = (
        running.select(*group, "bucket", *[f"{m}_before" for m in names], F.explode(inside).alias("w"))
        .select(*group, "bucket", *[f"{m}_before" for m in names], "w.cut", "w.need")
    )
    position = Window.partitionBy(*group, "cut").orderBy("h")
    return (
        lookup_join(keyed, hits, [*group, "bucket"])
        .withColumn("position", F.row_number().over(position) + F.col("n_before"))
        .where(F.col("position") <= F.col("need"))
        .groupBy(*group, "cut", "need")
        .agg(F.max("h").alias("cutoff"), *[(F.max(f"{m}_before") + F.sum(m)).alias(m) for m in measures])
    )


def ranked_values(
    df: DataFrame,
    group: list[str],
    value: str,
    ranks: Callable[[Column], Column] | None = None,
    *,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """(group, rank, v, total): the values at the wanted 1-based ranks.

    The distinct ranks come either from ``ranks``, a function of the group's
    row count giving an array, or from ``wanted``, a table (group, rank).
    """
    keyed = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    keyed = keyed.withColumn("bucket", value_bucket("v"))
    coarse = keyed.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    if wanted is None:
        sizes = coarse.groupBy(*group).agg(F.sum("n").alias("total"))
        wanted = sizes.select(*group, F.explode(ranks(F.col("total"))).alias("rank"))
    hits, local, fullest = measured(_buckets_of_ranks(_running(coarse, group, ["n"]), wanted, group), "n")
    for bits in FINER:
        if fullest <= BUCKET_ROWS:
            break
        keyed, hits, local, fullest = _finer(keyed, hits, local, group, bits)
    # The rows of the hit buckets, ties collapsed before they are ordered.
    rows = lookup_checked(keyed, hits.select(*group, "bucket"), local, [*group, "bucket"])
    cells = rows.groupBy(*group, "bucket", "v").agg(F.count("*").alias("n"))
    spans = cells.withColumn("upto", F.sum("n").over(Window.partitionBy(*group, "bucket").orderBy("v")))
    matched = F.filter(
        "ranks",
        lambda r: (r > F.col("n_before") + F.col("upto") - F.col("n")) & (r <= F.col("n_before") + F.col("upto")),
    )
    return lookup_checked(spans, hits.drop("n"), local, [*group, "bucket"]).select(
        *group, F.explode(matched).alias("rank"), "v", "total"
    )


def _finer(keyed: DataFrame, hits: DataFrame, local: bool, group: list[str], bits: int) -> tuple[DataFrame, DataFrame, bool, int]:
    """Rows of the hit buckets in finer buckets, and which of those hold the ranks; the rows are written, so that the source is not read again."""
    kept = lookup_checked(keyed, hits.select(*group, "bucket"), local, [*group, "bucket"])
    cut = staged(kept.select(*group, F.col("bucket").alias("outer"), F.shiftright(value_key("v"), bits).alias("bucket"), "v"), "finer")
    inside = [*group, "outer"]
    counts = cut.groupBy(*inside, "bucket").agg(F.count("*").alias("n"))
    before = hits.select(*group, F.col("bucket").alias("outer"), F.col("n_before").alias("base"), F.col("total").alias("whole"), "ranks")
    placed = lookup_checked(_running(counts, inside, ["n"]).drop("total"), before, local, inside)
    running = placed.select(*inside, "bucket", "n", (F.col("n_before") + F.col("base")).alias("n_before"), F.col("whole").alias("total"))
    wanted = before.select(*inside, F.explode("ranks").alias("rank"))
    return cut.drop("outer"), *measured(_buckets_of_ranks(running, wanted, inside).drop("outer"), "n")


def _buckets_of_ranks(running: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
    """(group, bucket, n_before, total, n, ranks): the buckets that hold a wanted rank.

    Buckets and ranks are merged along their position; going down, the last
    bucket seen is the one a rank falls in.
    """
    here = F.struct("bucket", "n_before", "total", "n")
    buckets = running.select(*group, (F.col("n_before") + F.col("n")).alias("pos"), F.lit(0).alias("is_rank"), here.alias("at"))
    asked = wanted.select(*group, F.col("rank").alias("pos"), F.lit(1).alias("is_rank"), F.lit(None).alias("at"))
    down = Window.partitionBy(*group).orderBy(F.desc("pos"), "is_rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        buckets.unionByName(asked)
        .withColumn("at", F.last("at", ignorenulls=True).over(down))
        .where("is_rank = 1 and at is not null")
        .groupBy(*group, "at.bucket", "at.n_before", "at.total", "at.n")
        .agg(F.collect_list("pos").alias("ranks"))
    )


def quantile_grid(df: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """(group, idx, prob, quantile, total): exact linearly interpolated quantiles."""
    levels = F.array(*[F.lit(float(p)) for p in probs])

    def lower(total: Column, p: Column) -> Column:
        return F.floor((total - 1).cast("double") * p).cast("long") + 1

    def needed(total: Column) -> Column:
        lows = F.transform(levels, lambda p: lower(total, p))
        highs = F.transform(lows, lambda r: F.least(r + 1, total))
        return F.array_distinct(F.concat(lows, highs))

    at_rank = (
        ranked_values(df, group, value, needed)
        .groupBy(*group)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"),
            F.max("total").alias("total"),
        )
    )

    def at_level(p: Column) -> Column:
        low = lower(F.col("total"), p)
        below, above = F.element_at("at", low), F.element_at("at", F.least(low + 1, F.col("total")))
        part = (F.col("total") - 1).cast("double") * p - (low - 1).cast("double")
        return F.struct(p.alias("prob"), (below + (above - below) * part).alias("quantile"))

    return at_rank.select(*group, "total", F.posexplode(F.transform(levels, at_level)).alias("idx", "q")).select(
        *group, "idx", "q.prob", "q.quantile", "total"
    )


def quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column for each named quantile."""
    names = list(probs)
    grid = quantile_grid(df, group, value, list(probs.values()))
    return grid.groupBy(*group).agg(
        *[F.max(F.when(F.col("idx") == i, F.col("quantile"))).alias(n) for i, n in enumerate(names)]
    )


def cumulative(
    df: DataFrame,
    group: list[str],
    value: str,
    measures: dict[str, Column],
    *,
    descending: bool = False,
    lead: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Running sums over the distinct values of each group.

    Ties are collapsed first. A cell gets ``cum_<m>`` = the sum of the measure
    over all values up to and including its own (from the top when
    ``descending``). With ``lead`` it also gets ``next_<m>``, the measure of the
    following cell, null at the end, with ``totals`` ``all_<m>``, the sum over the group. The source is read once.
    """
    names = list(measures)
    cells = (
        df.groupBy(*group, value)
        .agg(*[F.sum(c.cast("long")).alias(m) for m, c in measures.items()])
        .withColumn("bucket", value_bucket(F.col(value).cast("double")))
    )
    along = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    first = F.max_by if descending else F.min_by
    coarse = cells.groupBy(*group, "bucket").agg(
        *[F.sum(m).alias(m) for m in names],
        # The bucket of null is one cell, for which no order is known.
        *([F.coalesce(first(m, value), F.max(m)).alias(f"head_{m}") for m in names] if lead else []),
    )
    buckets = Window.partitionBy(*group).orderBy(along("bucket"))
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select(
        *group,
        "bucket",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"base_{m}") for m in names],
        *([F.lead(f"head_{m}").over(buckets).alias(f"follow_{m}") for m in names] if lead else []),
        *([F.sum(m).over(Window.partitionBy(*group)).alias(f"all_{m}") for m in names] if totals else []),
    )
    values = Window.partitionBy(*group, "bucket").orderBy(along(value))
    # Null-safe, so that both branches read the same shuffle of the same scan (no filter is inferred on one side only).
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*group, "bucket"]]
    extra = [c for c in offsets.columns if c not in (*group, "bucket")]
    joined = cells.alias("c").join(offsets.alias("o"), on).select("c.*", *[F.col(f"o.{c}").alias(c) for c in extra])
    return joined.select(
        *group,
        value,
        *names,
        *[(F.col(f"base_{m}") + F.sum(m).over(values)).alias(f"cum_{m}") for m in names],
        *(
            [F.coalesce(F.lead(m).over(values), F.col(f"follow_{m}")).alias(f"next_{m}") for m in names]
            if lead
            else []
        ),
        *([f"all_{m}" for m in names] if totals else []),
    )
