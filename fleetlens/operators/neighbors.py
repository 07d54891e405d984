"""Exact k-nearest-neighbour join inside devices.

Train points are grouped into cells around pivots, whose number grows with the
data: about one per CELL_ROWS rows. Up to FLAT_CELLS cells the pivots are
broadcast. Beyond that they form a tree of two levels: the square root of
their number is broadcast as top pivots, and the cells below a top pivot are a
table that meets its rows in bounded blocks, so nothing that is broadcast or
collected grows faster than that root.

A query looks into its own cell first. The k-th distance found there bounds
what it still needs, and the triangle inequality rules out all cells beyond
that bound; the rest are visited and the lists merged. The answer is exact,
and on data with any structure a query visits few cells, so the rows shuffled
grow with the number of rows. Cells and the queries sent to them are cut into
blocks of bounded size; a task compares one pair of blocks at a time. Copies
of a point beyond the k + 1 lowest ids can never be chosen (ties go to the
lower id) and are left out before the join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from fleetlens.operators.joins import bounded_local, lookup_checked
from fleetlens.session import staged

# Rows of a cell and of a block, queries of a block and of one matrix, cells up to which one level of pivots serves.
CELL_ROWS, BLOCK_ROWS, QUERY_ROWS, STEP_ROWS = 4096, 16384, 4096, 512
FLAT_CELLS = 4096
# Least queries of a block, blocks a core should get, rows of a cell for each neighbour wanted.
LEAST_QUERIES, BLOCKS_A_CORE, ROWS_A_NEIGHBOUR = 256, 4, 64
# Bounds of a step: cells of its matrix, candidates compared exactly, rows sent on; one tile of it stays in the cache.
MATRIX_CELLS, EXACT_PAIRS, SENT_ROWS = 1 << 21, 1 << 15, 1 << 13
TILE_ROWS, TILE_COLUMNS = 32, 1024
# Pairs compared exactly at a time, so that their coordinates stay in the cache; coordinates up to which single precision serves.
PAIRS_AT_ONCE, SINGLE_RANGE = 1 << 11, 1e15
METRICS = ("euclidean", "manhattan")
NO_PIVOT = -1
LISTS = "device_id int, rid long, id long, nn array<struct<dist:double,id:long>>"
EMPTY_LISTS = pa.schema(
    [("device_id", pa.int32()), ("rid", pa.int64()), ("id", pa.int64()), ("nn", pa.list_(pa.struct([("dist", pa.float64()), ("id", pa.int64())])))]
)
CELL = ["device_id", "top", "cell"]


# ---- distances ------------------------------------------------------------------


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of matching rows, in double."""
    gap = a - b
    return np.abs(gap).sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))


def _city_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distances tile by tile, so that the sums of a tile stay in the cache."""
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    room = np.empty((TILE_ROWS, TILE_COLUMNS))
    for top in range(0, len(a), TILE_ROWS):
        x = a[top : top + TILE_ROWS]
        for left in range(0, len(b), TILE_COLUMNS):
            y, tile = columns[:, left : left + TILE_COLUMNS], out[top : top + TILE_ROWS, left : left + TILE_COLUMNS]
            gap, total = room[: tile.shape[0], : tile.shape[1]], np.zeros(tile.shape)
            for j in range(a.shape[1]):
                np.subtract(x[:, j, None], y[j], out=gap)
                np.abs(gap, out=gap)
                total += gap
            tile[...] = total
    return out


def _city_block_single(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """``_city_block`` in single precision: |x - y| is 2 max(x, y) - x - y, one pass less over a tile; ``of_`` are the sums of rows."""
    out, columns = np.empty((len(a), len(b)), "float32"), np.ascontiguousarray(b.T)
    room, sums = np.empty((2, TILE_ROWS, TILE_COLUMNS), "float32")
    for top in range(0, len(a), TILE_ROWS):
        x = np.ascontiguousarray(a[top : top + TILE_ROWS].T)[:, :, None]
        for left in range(0, len(b), TILE_COLUMNS):
            y, tile = columns[:, left : left + TILE_COLUMNS], out[top : top + TILE_ROWS, left : left + TILE_COLUMNS]
            larger, total = (m[: tile.shape[0], : tile.shape[1]] for m in (room, sums))
            total[...] = 0
            for j in range(a.shape[1]):
                np.maximum(x[j], y[j], out=larger)
                np.add(total, larger, out=total)
            np.multiply(total, 2, out=total)
            np.subtract(total, of_a[top : top + TILE_ROWS, None], out=total)
            np.subtract(total, of_b[left : left + TILE_COLUMNS], out=tile)
    return out


def distance_matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return _city_block(a, b)
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def _rough(q: np.ndarray, t: np.ndarray, metric: str) -> Callable:
    """Fast distances of some rows of ``q`` to all of ``t``, as (values, a distance in their measure, slack of a limit).

    Coordinates around the centre of ``t`` in single precision; euclidean distances stay squared. The slack is twice the
    worst rounding of a value. Rows that single precision has no room for, or that are not finite, are compared in double.
    """
    with np.errstate(all="ignore"):
        centre = t.mean(axis=0)
        a, b = q - centre, t - centre
        single = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) < SINGLE_RANGE
    if not single:

        def double(at: slice) -> tuple:
            x = q[at]
            return distance_matrix(x, t, metric), lambda d: d, lambda limit: 1e-6 * limit + 1e-5 * (1.0 + np.sqrt((x * x).sum(1)))

        return double
    size = (lambda x: np.abs(x).sum(1)) if metric == "manhattan" else (lambda x: (x * x).sum(1))
    of_a, of_b, a, b = size(a), size(b), a.astype("float32"), b.astype("float32")
    slack, columns, lengths = 2.4e-7 * (q.shape[1] + 16) * (of_a + of_b.max()) + 1e-12, b.T, of_b.astype("float32")

    sums = [x.sum(axis=1, dtype="float64").astype("float32") for x in (a, b)]

    def work(at: slice) -> tuple:
        if metric == "manhattan":
            return _city_block_single(a[at], b, sums[0][at], sums[1]), lambda d: d, lambda limit: slack[at]
        values = a[at] @ columns
        values *= -2
        values += of_a[at].astype("float32")[:, None]
        values += lengths
        return values, np.square, lambda limit: slack[at]

    return work


def _slack(size: np.ndarray) -> np.ndarray:
    """Covers the rounding of matrix distances of points with coordinate sums up to ``size``."""
    return 1e-6 * (1.0 + size)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list<float> column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _steps(n: int, rows: int = STEP_ROWS) -> Iterator[slice]:
    rows = max(1, min(rows, STEP_ROWS))
    for start in range(0, n, rows):
        yield slice(start, min(start + rows, n))


# ---- blocks ----------------------------------------------------------------------


def _block_sizes(left: DataFrame, right: DataFrame, keys: list[str], left_rows: int, right_rows: int | None) -> DataFrame:
    """(keys, _lb, _rb): how many blocks each side of a key is cut into."""
    blocks = lambda rows: F.ceil(F.count("*") / rows).cast("int")
    mine = left.groupBy(*keys).agg(blocks(left_rows).alias("_lb"))
    if right_rows is None:
        return mine.withColumn("_rb", F.lit(1))
    return mine.join(right.groupBy(*keys).agg(blocks(right_rows).alias("_rb")), keys, "left").fillna(1, ["_rb"])


def _in_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], left_key: str, right_key: str, left_rows: int, right_rows: int | None,
    work: Callable, schema: str, *, whole: bool = False,
) -> DataFrame:
    """work(left block, right block) over all pairs of blocks of a key; a left block without right rows gets an empty one.

    ``whole`` says that both tables are known to fit into one block. Pairs are dealt to a given number of tasks: their
    bytes say little of their work, so small shuffles must not be merged into a few tasks.
    """
    if whole:
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)
    sizes = _block_sizes(left, right, keys, left_rows, right_rows)
    local = bounded_local(sizes)
    sizes, small = (sizes, False) if local is None else (local, True)

    def cut(rows: DataFrame, key: str, mine: str, other: str, here: str, there: str) -> DataFrame:
        placed = lookup_checked(rows, sizes, small, keys)
        placed = placed.withColumn(here, F.pmod(F.xxhash64(F.col(key)), F.col(mine)).cast("int"))
        return placed.withColumn(there, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_lb", "_rb")

    pair, tasks = [*keys, "_l", "_r"], _tasks(left)
    a = cut(left, left_key, "_lb", "_rb", "_l", "_r").repartition(tasks, *pair).groupBy(*pair)
    z = cut(right, right_key, "_rb", "_lb", "_r", "_l").repartition(tasks, *pair).groupBy(*pair)
    return a.cogroup(z).applyInArrow(work, schema)


def _tasks(rows: DataFrame) -> int:
    """Tasks that pairs of blocks are dealt to: some for each core, and no fewer than any other shuffle has."""
    spark = rows.sparkSession
    return max(BLOCKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _nearest(need: int, metric: str) -> Callable:
    """The ``need`` nearest train rows of each query of a block, not farther than its bound."""

    def work(queries: pa.Table, train: pa.Table) -> pa.Table:
        if not len(queries):
            return pa.Table.from_pylist([], EMPTY_LISTS)
        q, t = _matrix(queries["features"]), _matrix(train["features"])
        ids, keep = _numbers(train["id"]), min(need, len(t))
        bound = _numbers(queries["bound"])
        sizes, dists, found = [np.zeros(len(q), "int64")], [], []
        rough = _rough(q, t, metric) if keep else None
        for at in _steps(len(q), min(MATRIX_CELLS // len(t), EXACT_PAIRS // keep)) if keep else ():
            x = q[at]
            values, rated, slack = rough(at)
            # Candidates by the fast matrix form, then exact distances in (distance, id) order.
            limit = np.minimum(np.partition(values, keep - 1, axis=1)[:, keep - 1], rated(bound[at]))
            # The next larger single, lest the limit be rounded down.
            over = np.nextafter((limit + slack(limit)).astype(values.dtype), values.dtype.type(np.inf))
            row, col = np.divmod(np.flatnonzero(values <= over[:, None]), len(t))
            parts = [pair_distances(x[row[i : i + PAIRS_AT_ONCE]], t[col[i : i + PAIRS_AT_ONCE]], metric) for i in range(0, len(row), PAIRS_AT_ONCE)]
            dist = np.concatenate(parts) if parts else np.zeros(0)
            order = np.lexsort((ids[col], dist, row))
            row, col, dist = row[order], col[order], dist[order]
            chosen = np.arange(len(row)) - np.searchsorted(row, row) < keep
            sizes[0][at] = np.bincount(row[chosen], minlength=len(x))
            dists.append(dist[chosen])
            found.append(ids[col[chosen]])
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[0]))), pa.int32())
        values = [np.concatenate(v) if v else np.zeros(0, k) for v, k in ((dists, "float64"), (found, "int64"))]
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v) for v in values], ["dist", "id"]))
        return pa.table([*(queries[c].combine_chunks() for c in ("device_id", "rid", "id")), lists], ["device_id", "rid", "id", "nn"])

    return work


def _compare(queries: DataFrame, train: DataFrame, need: int, metric: str, whole: bool = False, query_rows: int = QUERY_ROWS, keys: list[str] = CELL) -> DataFrame:
    """Lists of the nearest rows of each query in the cell (or, by ``keys``, the device) it was sent to."""
    q = queries.select(*keys, "rid", "id", "features", "bound")
    t = train.select(*keys, "id", "features", F.col("rid").alias("tid"))
    return _in_pairs(q, t, keys, "rid", "tid", query_rows, BLOCK_ROWS, _nearest(need, metric), LISTS, whole=whole)


# ---- pivots and cells --------------------------------------------------------------


class Pivots:
    """Pivots of some devices: their numbers, points, nearest and farthest row, and rows."""

    def __init__(self, rows: list, fields: tuple[str, ...] = ()):
        grouped: dict[int, list] = {}
        for r in rows:
            grouped.setdefault(r["device_id"], []).append(r)
        self.numbers = {d: np.array([r["number"] for r in v], "int64") for d, v in grouped.items()}
        self.points = {d: np.asarray([r["point"] for r in v], "float64") for d, v in grouped.items()}
        self.fields = {f: {d: np.array([r[f] for r in v]) for d, v in grouped.items()} for f in fields}


def _sample(train: DataFrame, sizes: DataFrame, small: bool, per_pivot: float, seed: str) -> DataFrame:
    """Rows taken as pivots by hash, about one per ``per_pivot``; none of a device that is a single cell."""
    chosen = train.where(F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(1 << 40)) < int((1 << 40) / per_pivot))
    return lookup_checked(chosen, sizes, small, ["device_id"]).where(F.col("rows") > per_pivot).select("device_id", F.col("rid").alias("number"), F.col("features").alias("point"))


def _batches(rows: DataFrame, schema: str, work: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return rows.mapInArrow(run, schema)


def _by_device(batch) -> Iterator[tuple[int, np.ndarray]]:
    devices = _numbers(batch["device_id"])
    for device in np.unique(devices):
        yield int(device), np.nonzero(devices == device)[0]


def _closest(points: np.ndarray, centres: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest centre of each point."""
    at, dist = np.zeros(len(points), "int64"), np.zeros(len(points))
    for part in _steps(len(points)):
        d = distance_matrix(points[part], centres, metric)
        at[part] = d.argmin(axis=1)
        dist[part] = np.take_along_axis(d, at[part, None], 1)[:, 0]
    return at, dist


def _assigned(rows: DataFrame, pivots, metric: str, into: str, usable: str | None = None) -> DataFrame:
    """Adds the nearest broadcast pivot of the device (``into``) and its distance (``<into>_dist``)."""
    names = rows.columns

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chosen = pivots.value
        number, dist = np.full(batch.num_rows, NO_PIVOT, "int64"), np.full(batch.num_rows, np.nan)
        for device, at in _by_device(batch):
            if device in chosen.numbers:
                own = np.arange(len(chosen.numbers[device])) if usable is None else np.flatnonzero(chosen.fields[usable][device])
                if len(own):
                    nearest, dist[at] = _closest(_matrix(batch["features"].take(pa.array(at))), chosen.points[device][own], metric)
                    number[at] = chosen.numbers[device][own][nearest]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(dist)], [*names, into, f"{into}_dist"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return _batches(rows, f"{kinds}, {into} long, {into}_dist double", work)


def _reachable(points: np.ndarray, bound: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """Which cells (columns) may hold a row within its bound of each point; a cell without a centre may always."""
    d = distance_matrix(points, centres, metric)
    least = np.maximum(np.maximum(d - high[None, :], low[None, :] - d), 0.0)
    slack = _slack(np.where(np.isfinite(bound), bound, 0.0)[:, None] + np.abs(points).sum(1)[:, None] + np.abs(centres).sum(1)[None, :])
    return ~(least > bound[:, None] + slack)


def _summary(celled: DataFrame, by: list[str], distance: str) -> DataFrame:
    """Nearest and farthest row and rows of each cell (or top cell)."""
    return celled.groupBy(*by).agg(F.min(distance).alias("low"), F.max(distance).alias("high"), F.count("*").alias("n"))


def _with_points(summary: DataFrame, pivots: DataFrame, on: str) -> DataFrame:
    return summary.join(pivots.withColumnRenamed("number", on), ["device_id", on])


class FlatCells:
    """One level: all pivots broadcast, routing without a shuffle."""

    def __init__(self, train: DataFrame, sample: Callable, need: int, cell_rows: float, metric: str):
        self.metric, self.need = metric, need
        context = train.sparkSession.sparkContext
        points = staged(sample(cell_rows, "cells"), "knn-pivots")
        # Expected FLAT_CELLS rows at most; any set of pivots serves.
        chosen = context.broadcast(Pivots(points.limit(4 * FLAT_CELLS).collect()))
        celled = _assigned(train, chosen, metric, "cell").withColumn("top", F.lit(NO_PIVOT).cast("long"))
        self.train = staged(celled, "knn-cells")
        cells = _with_points(_summary(self.train.where(f"cell <> {NO_PIVOT}"), ["device_id", "cell"], "cell_dist"), points, "cell")
        cells = cells.withColumn("number", F.col("cell")).withColumn("roomy", F.col("n") >= need)
        self.cells = context.broadcast(Pivots(cells.collect(), ("low", "high", "roomy")))

    def home(self, queries: DataFrame) -> DataFrame:
        return _assigned(queries, self.cells, self.metric, "cell", "roomy").withColumn("top", F.lit(NO_PIVOT).cast("long"))

    def elsewhere(self, queries: DataFrame) -> DataFrame:
        cells, metric = self.cells, self.metric

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            known = cells.value
            for device, rows in _by_device(batch):
                if device not in known.numbers:
                    continue
                for part in _steps(len(rows), SENT_ROWS // len(known.numbers[device])):
                    own = batch.take(pa.array(rows[part]))
                    fields = [known.fields[f][device] for f in ("low", "high")]
                    hit = _reachable(_matrix(own["features"]), _numbers(own["bound"]), known.points[device], *fields, metric)
                    hit &= known.numbers[device][None, :] != _numbers(own["cell"])[:, None]
                    yield _sent(own, *np.nonzero(hit), known.numbers[device])

        return _batches(queries.select(*ROUTED), ROUTED_SCHEMA, work)


ROUTED = ["device_id", "top", "cell", "rid", "id", "features", "bound"]
ROUTED_SCHEMA = "device_id int, top long, cell long, rid long, id long, features array<float>, bound double"


def _sent(rows: pa.RecordBatch | pa.Table, row: np.ndarray, col: np.ndarray, cells: np.ndarray, tops: np.ndarray | None = None):
    """``rows`` repeated for the cells they are sent to."""
    out = rows.take(pa.array(row))
    columns = {c: out[c] for c in ROUTED}
    columns["cell"] = pa.array(cells[col])
    if tops is not None:
        columns["top"] = pa.array(tops[col])
    made = pa.Table.from_pydict(columns).combine_chunks()
    return made if isinstance(rows, pa.Table) else (made.to_batches() or [pa.RecordBatch.from_pylist([], made.schema)])[0]


class TreeCells:
    """Two levels: top pivots broadcast, the cells below one joined with its rows in blocks."""

    def __init__(self, train: DataFrame, sample: Callable, need: int, cell_rows: float, n_cells: float, metric: str):
        self.metric, self.need = metric, need
        context = train.sparkSession.sparkContext
        tops = staged(sample(cell_rows * math.sqrt(n_cells), "tops"), "knn-tops")
        # About the square root of the number of cells.
        chosen = context.broadcast(Pivots(tops.limit(4 * int(math.sqrt(n_cells)) + FLAT_CELLS).collect()))
        topped = staged(_assigned(train, chosen, metric, "top"), "knn-topped")
        inner = _assigned(sample(cell_rows, "cells").withColumnRenamed("point", "features"), chosen, metric, "top")
        below = inner.select("device_id", "top", "number", F.col("features").alias("point"))
        # A top pivot is a cell of its own as well, so none is without cells.
        every = tops.withColumn("top", F.col("number")).unionByName(below).dropDuplicates(CELL[:2] + ["number"])
        points = staged(every, "knn-pivots")
        self.train = staged(self._settle(topped, points), "knn-cells")
        below = self.train.where(f"cell <> {NO_PIVOT}")
        cells = _summary(below, CELL, "cell_dist").join(points.withColumnRenamed("number", "cell"), CELL)
        self.cells = staged(cells.withColumn("roomy", F.col("n") >= need), "knn-cell-table")
        inside = self.cells.groupBy("device_id", "top").agg(F.max("roomy").alias("roomy"))
        over = _summary(self.train, ["device_id", "top"], "top_dist").join(inside, ["device_id", "top"], "left").fillna(False, ["roomy"])
        over = _with_points(over.where(f"top <> {NO_PIVOT}"), tops, "top").withColumn("number", F.col("top"))
        self.tops = context.broadcast(Pivots(over.collect(), ("low", "high", "roomy")))

    def _settle(self, rows: DataFrame, cells: DataFrame) -> DataFrame:
        """Adds the nearest cell below the row's top pivot."""
        names, metric = rows.columns, self.metric
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

        def work(rows: pa.Table, cells: pa.Table) -> pa.Table:
            number, dist = np.full(len(rows), NO_PIVOT, "int64"), np.full(len(rows), np.nan)
            if len(cells) and len(rows):
                at, dist = _closest(_matrix(rows["features"]), _matrix(cells["point"]), metric)
                number = _numbers(cells["number"])[at]
            return pa.table([*(rows[c] for c in names), pa.array(number), pa.array(dist)], [*names, "cell", "cell_dist"])

        on = ["device_id", "top"]
        return _in_pairs(rows, cells, on, "rid", "number", BLOCK_ROWS, None, work, f"{kinds}, cell long, cell_dist double")

    def home(self, queries: DataFrame) -> DataFrame:
        topped = _assigned(queries, self.tops, self.metric, "top", "roomy")
        cells = self.cells.where("roomy").select("device_id", "top", F.col("cell").alias("number"), "point")
        return self._settle(topped, cells)

    def elsewhere(self, queries: DataFrame) -> DataFrame:
        tops, metric = self.tops, self.metric

        def to_tops(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            known = tops.value
            batch = batch.append_column("home", batch["cell"])
            for device, rows in _by_device(batch):
                for part in _steps(len(rows)):
                    own = batch.take(pa.array(rows[part]))
                    home = own["home"]
                    if device not in known.numbers:
                        # No top pivot: the cells of the device hang below none.
                        yield pa.RecordBatch.from_arrays([*(own[c] for c in ROUTED), home], [*ROUTED, "home"])
                        continue
                    fields = [known.fields[f][device] for f in ("low", "high")]
                    row, col = np.nonzero(_reachable(_matrix(own["features"]), _numbers(own["bound"]), known.points[device], *fields, metric))
                    made = _sent(own, row, np.zeros(len(row), "int64"), np.array([NO_PIVOT]))
                    made = made.set_column(made.schema.get_field_index("top"), "top", pa.array(known.numbers[device][col]))
                    yield made.append_column("home", home.take(pa.array(row)))

        def to_cells(rows: pa.Table, cells: pa.Table) -> pa.Table:
            if not len(cells) or not len(rows):
                return rows.select(ROUTED).slice(0, 0)
            parts = []
            numbers, low, high = (_numbers(cells[c]) for c in ("number", "low", "high"))
            for part in _steps(len(rows)):
                own = rows.slice(part.start, part.stop - part.start)
                hit = _reachable(_matrix(own["features"]), _numbers(own["bound"]), _matrix(cells["point"]), low, high, metric)
                hit &= numbers[None, :] != _numbers(own["home"])[:, None]
                parts.append(_sent(own, *np.nonzero(hit), numbers))
            return pa.concat_tables(parts)

        at_top = _batches(queries.select(*ROUTED), f"{ROUTED_SCHEMA}, home long", to_tops)
        cells = self.cells.select("device_id", "top", F.col("cell").alias("number"), "point", "low", "high")
        return _in_pairs(staged(at_top, "knn-at-tops"), cells, ["device_id", "top"], "rid", "number", QUERY_ROWS, None, to_cells, ROUTED_SCHEMA)


# ---- the join ------------------------------------------------------------------------


def _numbered(rows: DataFrame, *more: Column) -> DataFrame:
    # -0.0 and 0.0 are one value here.
    plain = F.transform("features", lambda x: x + F.lit(0.0).cast("float"))
    return rows.select(F.col("device_id").cast("int").alias("device_id"), F.col("id").cast("long").alias("id"), plain.alias("features"), *more)


def _staged_counted(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The written table and its rows, counted by the job that writes it."""
    seen = Observation()
    return staged(rows.observe(seen, F.count(F.lit(1)).alias("n")), label), seen.get["n"]


def _merged(lists: DataFrame, need: int) -> DataFrame:
    """Lists of one query from several cells or blocks to its ``need`` nearest."""
    # sort_array, not array_sort: the latter runs a lambda for every comparison. A list that is alone is in order.
    several = F.slice(F.sort_array(F.flatten("lists")), 1, need)
    found = lists.groupBy("device_id", "rid").agg(F.first("id").alias("id"), F.collect_list("nn").alias("lists"))
    return found.select("device_id", "rid", "id", F.when(F.size("lists") == 1, F.col("lists")[0]).otherwise(several).alias("nn"))


def knn_join(
    queries: DataFrame, train: DataFrame, k: int, *, metric: str = "euclidean", exclude_self: bool | str = False, cell_rows: int | None = None, flat_cells: int = FLAT_CELLS
) -> DataFrame:
    """(device_id, id, neighbors): the k nearest train points of each query in its device.

    Both tables have device_id, id (long) and features (array<float>).
    ``neighbors`` is an array of (dist, id) in (dist, id) order. With
    ``exclude_self`` a query does not count the train row of its own id; as the name
    of a boolean column of the queries it says so row by row, and the result has that column too.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    need = k + 1 if exclude_self else k
    if cell_rows is None:
        # A visited cell answers with up to ``need`` rows: long lists come from larger cells.
        cell_rows = max(CELL_ROWS, min(BLOCK_ROWS, ROWS_A_NEIGHBOUR * need))
    # A cell has room for what a query needs.
    cell_rows = max(cell_rows, 4 * need)
    copies = F.row_number().over(Window.partitionBy("device_id", "features").orderBy("id"))
    # A rank limit on a window is applied before the shuffle too, so copies stay where they are.
    single = _numbered(train).withColumn("_copy", copies).where(F.col("_copy") <= need).drop("_copy")
    train, n_train = _staged_counted(single.withColumn("rid", F.monotonically_increasing_id()), "knn-train")
    # Odd numbers are given to queries that do not count themselves.
    alone = F.col(exclude_self) if isinstance(exclude_self, str) else F.lit(exclude_self)
    rid = F.monotonically_increasing_id() * 2 + F.col("_alone").cast("long")
    queries, n_queries = _staged_counted(_numbered(queries, alone.alias("_alone")).withColumn("rid", rid).drop("_alone"), "knn-queries")
    queries = queries.withColumn("bound", F.lit(math.inf))
    # Few queries are cut into more blocks, so that every core has some.
    cores = train.sparkSession.sparkContext.defaultParallelism
    query_rows = min(QUERY_ROWS, max(LEAST_QUERIES, math.ceil(n_queries / (BLOCKS_A_CORE * cores))))
    sizes, n_cells = train.groupBy("device_id").agg(F.count("*").alias("rows")), 0.0
    if n_train > cell_rows:
        cells_of = F.when(F.col("rows") > cell_rows, F.col("rows") / cell_rows)
        n_cells = sizes.agg(F.sum(cells_of)).first()[0] or 0.0
    if not n_cells:
        # Every device is a single cell: there is nothing to rule out.
        whole = n_queries <= query_rows and n_train <= BLOCK_ROWS
        found = _compare(queries, train, need, metric, whole, query_rows, ["device_id"])
        if cell_rows > BLOCK_ROWS and not whole:
            found = _merged(found, need)
    else:
        local = bounded_local(sizes)

        def sample(per_pivot: float, seed: str) -> DataFrame:
            return _sample(train, sizes if local is None else local, local is not None, per_pivot, seed)

        if n_cells <= flat_cells:
            cells = FlatCells(train, sample, need, cell_rows, metric)
        else:
            cells = TreeCells(train, sample, need, cell_rows, n_cells, metric)
        at_home = staged(cells.home(queries).select(*ROUTED), "knn-home")
        first = staged(_merged(_compare(at_home, cells.train, need, metric, query_rows=query_rows), need), "knn-first")
        reach = F.when(F.size("nn") >= need, F.element_at("nn", need)["dist"]).otherwise(F.lit(math.inf))
        bounded = at_home.drop("bound").join(first.select("device_id", "rid", reach.alias("bound")), ["device_id", "rid"])
        sent = staged(cells.elsewhere(bounded), "knn-sent")
        found = _merged(first.unionByName(_compare(sent, cells.train, need, metric)), need)
    alone = F.col("rid") % 2 == 1
    others = F.when(alone, F.filter("nn", lambda x: x["id"] != F.col("id"))).otherwise(F.col("nn")) if exclude_self else F.col("nn")
    said = [alone.alias(exclude_self)] if isinstance(exclude_self, str) else []
    return found.select("device_id", "id", F.slice(others, 1, k).alias("neighbors"), *said)
