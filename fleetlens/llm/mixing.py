"""Mixing sources to target weights by Pfair scheduling.

A source with weight a/T (whole numbers, T their sum) owns block j from its
release floor(j T / a) to its deadline ceil((j + 1) T / a). In every slot the
released block with the earliest deadline runs, ties going to the first source
in name order. After every slot each source has had less than one block more
or less than its share. The schedule repeats after T slots, so one frame of T
slots is made once; block j of a source then runs in slot
frame(j mod a) + T (j div a).

The frame is a table. A small one is a fold over its slots inside one
expression. A large one is made by halving: deadlines give the blocks a fixed
order of precedence, the slots that the half of higher precedence takes follow
from running sums of releases alone, the other half gets the remaining slots,
and both halves go on like this, all at once, for log2 T rounds. The plan does
not grow with the number of sources. Rows find their slot by a join on the
block's place in the frame; rows of earlier slots are running sums over blocks
in bounded windows.

A source that runs out leaves its slots empty; ``position`` counts only rows,
so the other sources close up, and ``on_target`` marks the rows before the
first source ran out, up to which the bound holds. Nothing is dropped.

Defined results: a null source is a source of its own; sources without weight
are refused, weights without rows leave empty slots; rows are told apart by
key and text, equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import accumulate
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetlens.llm.numbering import numbered
from fleetlens.session import staged

BLOCK = 64
MAX_FRAME = 1 << 24  # slots of a frame: how finely weights may differ, not how many sources there are
FOLD_CELLS = 50_000  # slots times sources up to which one expression makes the frame
FRAME_ROWS = 200_000  # of a frame that is broadcast
RUN = 4096  # slots of a window, and windows of a run


def whole_weights(weights: dict[str | None, int]) -> dict[str | None, int]:
    """Weights divided by what they share; whole and positive, their sum bounded."""
    if not weights or any(int(w) != w or w <= 0 for w in weights.values()):
        raise ValueError("weights are positive whole numbers")
    shared = gcd(*map(int, weights.values()))
    out = {s: int(w) // shared for s, w in weights.items()}
    if sum(out.values()) > MAX_FRAME:
        raise ValueError(f"weights sum to more than {MAX_FRAME} after division by what they share")
    return dict(sorted(out.items(), key=lambda e: (e[0] is not None, e[0])))


def _frame(shares: list[int]) -> Column:
    """array<int>: the source that each slot of one frame runs, -1 for none."""
    total, n = sum(shares), len(shares)
    a = F.array(*map(F.lit, shares))
    start = F.struct(F.array(*[F.lit(0)] * n).alias("done"), F.array().cast("array<int>").alias("slots"))

    def step(state: Column, t: Column) -> Column:
        done = state["done"]
        # (deadline, source) of every released block; the least one runs.
        ready = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda s: F.when(
                F.floor(done[s] * total / a[s]) <= t,
                F.struct(F.ceil((done[s] + 1) * total / a[s]).alias("deadline"), s.alias("source")),
            ),
        )
        pick = F.coalesce(F.array_min(F.filter(ready, lambda r: r.isNotNull()))["source"], F.lit(-1))
        return F.transform(F.array(pick), lambda p: F.struct(
            F.transform(done, lambda d, i: d + F.when(i == p, 1).otherwise(0)).alias("done"),
            F.array_append(state["slots"], p).alias("slots"),
        ))[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, step, lambda s: s["slots"])


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.5, resolution: int | None = None) -> dict[str | None, int]:
    """Target weights of all sources in proportion to a power of their row counts, one part in ``resolution`` at least.

    By default there are 200 parts, and twenty for each source where these are more.
    """
    # One row per source.
    counts = docs.groupBy(source).agg(F.count("*").alias("n")).collect()
    resolution = resolution or max(200, 20 * len(counts))
    whole = sum(r["n"] ** power for r in counts)
    return {r[source]: max(1, round(resolution * r["n"] ** power / whole)) for r in counts} or {None: 1}  # any weights do for no rows


def schedule(spark: SparkSession, weights: dict[str | None, int]) -> DataFrame:
    """(slot, source_no, nth): one frame; nth counts the blocks of the source in it."""
    shares = list(whole_weights(weights).values())
    if sum(shares) * len(shares) > FOLD_CELLS:
        return _halved(spark, shares)
    slots = spark.range(1).select(F.posexplode(_frame(shares)).alias("slot", "source_no"))
    nth = F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1
    return slots.withColumn("nth", nth)


def _halved(spark: SparkSession, shares: list[int]) -> DataFrame:
    """A frame by halving its blocks by precedence; every round is a written table.

    A group of blocks has as many slots, numbered from 0; ``rel`` is the first of them that a block may take. The
    half of higher precedence is served first: the slots it keeps busy are those where, counting its releases and
    taking one off per slot, something waits.
    """
    total = sum(shares)
    rounds = max(1, (total - 1).bit_length())
    given = spark.createDataFrame(list(enumerate(shares)), "source_no int, share long")
    each = given.select("source_no", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1)).alias("nth"))
    deadline = F.expr(f"((nth + 1) * {total} + share - 1) div share")
    timed = each.select("source_no", "nth", F.expr(f"(nth * {total}) div share").alias("rel"), deadline.alias("deadline"))
    order = F.row_number().over(Window.orderBy("deadline", "source_no")) - 1
    blocks = staged(timed.select("source_no", "nth", "rel", order.cast("long").alias("p"), F.lit(0).cast("long").alias("g")), "mix-blocks")
    slots = spark.range(total).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("x"), F.col("id").alias("slot"))
    along = Window.partitionBy("g").orderBy("x")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    for level in range(rounds - 1, -1, -1):
        first = F.shiftright("p", level).bitwiseAND(F.lit(1).cast("long")) == 0
        arrivals = blocks.where(first).groupBy("g", F.col("rel").alias("x")).agg(F.count("*").alias("c"))
        waiting = slots.join(arrivals, ["g", "x"], "left").fillna(0, ["c"]).withColumn("s", F.sum("c").over(along) - F.col("x") - 1)
        # Left over from the slots before: their net sum over its least value so far, which is 0 at the start.
        left = F.coalesce(F.lag("s").over(along) - F.least(F.min("s").over(past), F.lit(0)), F.lit(0))
        taken = waiting.withColumn("busy", (left + F.col("c") > 0).cast("long"))
        counted = staged(taken.withColumn("ahead", F.coalesce(F.sum("busy").over(past), F.lit(0))).select("g", "x", "slot", "busy", "ahead"), "mix-taken")
        slots = counted.select(
            (F.col("g") * 2 + 1 - F.col("busy")).alias("g"), F.when(F.col("busy") == 1, F.col("ahead")).otherwise(F.col("x") - F.col("ahead")).alias("x"), "slot"
        )
        place = counted.select("g", F.col("x").alias("rel"), "ahead")
        moved = blocks.join(place, ["g", "rel"]).select(
            "source_no", "nth", F.when(first, F.col("ahead")).otherwise(F.col("rel") - F.col("ahead")).alias("rel"), "p",
            (F.col("g") * 2 + F.when(first, 0).otherwise(1)).alias("g"),
        )
        blocks = staged(moved, "mix-blocks")
    return slots.join(blocks, "g").select("slot", "source_no", "nth")


def _rows_before(blocks: DataFrame) -> DataFrame:
    """Adds ``before``, the rows of all blocks in earlier slots: sums over runs of windows, windows and slots."""
    cut = blocks.withColumn("_w", F.floor(F.col("slot") / RUN).cast("long")).withColumn("_run", F.floor(F.col("_w") / RUN).cast("long"))
    windows = cut.groupBy("_run", "_w").agg(F.sum("rows").alias("rows"))
    runs = windows.groupBy("_run").agg(F.sum("rows").alias("rows"))

    def sum_before(order: str, *part: str | Column) -> Column:
        return F.coalesce(F.sum("rows").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # One row per RUN * RUN slots.
    base = runs.select("_run", sum_before("_run", F.lit(0)).alias("_base"))
    inner = windows.select("_run", "_w", sum_before("_w", "_run").alias("_inner"))
    offsets = inner.join(base, "_run").select("_w", (F.col("_inner") + F.col("_base")).alias("_offset"))
    local = cut.withColumn("_local", sum_before("slot", "_w"))
    return local.join(offsets, "_w").select(*blocks.columns, (F.col("_local") + F.col("_offset")).alias("before"))


def mix(docs: DataFrame, weights: dict[str | None, int], block: int = BLOCK, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, row_in_source, block, release, deadline, slot, position, on_target): one row per input row."""
    spark, shares = docs.sparkSession, whole_weights(weights)
    total = sum(shares.values())
    known = spark.createDataFrame([(s, i, a) for i, (s, a) in enumerate(shares.items())], "_source string, _no int, _share long")
    sized = docs.groupBy(F.col(source).cast("string").alias("_name")).agg(F.count("*").alias("_n"))
    sized = sized.join(known, F.col("_name").eqNullSafe(F.col("_source")), "left")
    strange = F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("_name", F.lit("null"))))
    # At most one row per weight, like the weights themselves.
    sizes = sized.select(F.when(F.col("_no").isNull(), strange).otherwise(F.col("_no")).cast("int").alias("_no"), "_n").collect()
    held = {r["_no"]: r["_n"] for r in sizes}
    table = [(s, i, a, held.get(i, 0)) for i, (s, a) in enumerate(shares.items())]
    sources = spark.createDataFrame(table, "_source string, _no int, _share long, _n long")
    frame = staged(schedule(spark, weights), "mix-frame")
    frame = F.broadcast(frame) if total <= FRAME_ROWS else frame

    def in_frame(blocks: DataFrame) -> DataFrame:
        """Adds the slot of blocks (_no, _share, block)."""
        at = frame.select(F.col("source_no").alias("_no"), F.col("nth").cast("long").alias("_nth"), F.col("slot").cast("long").alias("_slot"))
        found = blocks.withColumn("_nth", F.pmod("block", "_share")).join(at, ["_no", "_nth"])
        return found.withColumn("slot", F.expr(f"(block div _share) * {total} + _slot")).drop("_nth", "_slot")

    rows = docs.select(F.col(key).alias(key), F.col(source).alias(source), F.xxhash64(text).alias("_text"))
    counted = numbered(rows, "row_in_source", [key], within=[source], total=sum(held.values()))
    owned = counted.join(F.broadcast(sources), F.col(source).cast("string").eqNullSafe(F.col("_source"))).drop("_source")
    owned = staged(owned.withColumn("block", F.expr(f"row_in_source div {block}")), "mix-rows")
    # Each block is known by its first row.
    heads = owned.where(F.col("row_in_source") % block == 0).select("_no", "_share", "block", F.least(F.lit(block), F.col("_n") - F.col("block") * block).alias("rows"))
    blocks = _rows_before(in_frame(heads))
    # A source has run out once the first block that it cannot fill has run.
    ends = in_frame(sources.select("_no", "_share", F.expr(f"_n div {block}").alias("block")))
    end = ends.agg(F.min("slot")).first()[0]
    placed = owned.drop("_share", "_n").join(blocks, ["_no", "block"])
    return placed.select(
        key, source, "_text", "row_in_source", "block",
        F.expr(f"(block * {total}) div _share").alias("release"), F.expr(f"((block + 1) * {total} + _share - 1) div _share").alias("deadline"),
        "slot", (F.col("before") + F.col("row_in_source") % block).alias("position"), (F.col("slot") <= end).alias("on_target"),
    )


def mixed(docs: DataFrame, weights: dict[str | None, int], block: int = BLOCK, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The input rows, columns unchanged, in schedule order: ranges of positions, each range sorted."""
    places = mix(docs, weights, block, key, source, text).select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), F.col("_text").alias("_hash"), "position"
    )
    # Equal rows lie together at the first of their places.
    packed = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.xxhash64(text).alias("_hash"))
    once = places.groupBy("_key", "_source", "_hash").agg(F.min("position").alias("_at"), F.count("*").alias("_n"))
    same = [packed[c].eqNullSafe(once[c]) for c in ("_key", "_source", "_hash")]
    joined = packed.join(once, same).select("_row", "_at")
    return joined.repartitionByRange("_at").sortWithinPartitions("_at").select("_row.*")


def _part_number(name: str) -> tuple[int, str]:
    """Parts by the number in their name, which is wider than five digits from part 100 000 on."""
    found = re.search(r"\d+", name)
    return int(found[0]) if found else 0, name


def placed(docs: DataFrame, into: str = "mix_position") -> DataFrame:
    """The rows of a stored table with their place in its order, from 0 and without gaps.

    Part names follow the ranges that ``mixed`` wrote, rows of a part keep their index; what Spark reads first does
    not matter. A table that is not stored is numbered in the order of its partitions.
    """
    carried = [c for c in docs.columns if c != into]
    if docs.inputFiles():
        part, index = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    else:
        part = F.lpad(F.spark_partition_id().cast("string"), 10, "0")
        index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = docs.select(*carried, part.alias("_part"), index.cast("long").alias("_index"))
    # One row per part file.
    counts = rows.groupBy("_part").agg(F.count("*").alias("n")).collect()
    sizes = sorted(((r["_part"], r["n"]) for r in counts), key=lambda s: _part_number(s[0]))
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = docs.sparkSession.createDataFrame([(p, at) for (p, _), at in zip(sizes, starts)], "_part string, _start long")
    return rows.join(F.broadcast(offsets), "_part").select(*carried, (F.col("_start") + F.col("_index")).alias(into))
