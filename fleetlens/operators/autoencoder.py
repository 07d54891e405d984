"""Autoencoders trained and applied as Spark jobs.

Training is synchronous parameter averaging: in every epoch each task runs
mini-batches over its share of the rows for every model it has rows of,
starting from the common parameters, and the results are averaged weighted by
rows. Rows of a device are spread over all tasks, so per-device and fleet-wide
models (``device_id`` 0 for all rows) train through the same job and no device
has to fit in one task. The driver holds only parameters, in waves of bounded
total size, and the epoch losses.

Mini-batches are cut from a shuffle buffer that fills across Arrow batches, so
their size and order depend on a task's rows alone, not on how files or
batches cut them. In the exact mode a step is the gradient over all rows: each
task adds up the gradients of its rows, Spark adds up the tasks, and the
optimiser moves once per pass, so the result is that of one machine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions import dense
from fleetlens.functions.expressions import hash_order
from fleetlens.operators.joins import lookup_join, required
from fleetlens.operators.ordering import quantiles
from fleetlens.operators.records import best_epoch, best_trial
from fleetlens.operators.thresholds import score_summary
from fleetlens.session import scratch_path, staged

FLEET = 0
MODEL_SCHEMA = (
    "device_id int, config_id string, spec string, params array<double>, best_epoch int, best_val_loss double, epochs_trained int"
)
HISTORY_SCHEMA = "device_id int, config_id string, epoch int, loss double, val_loss double, learning_rate double"
# Parameter values the driver and a task may hold at once (a wave of models).
WAVE_VALUES = 16_000_000
CHUNK = 16_384
ROWS_PER_TASK = 4096
# Fixed value: rows a shuffle buffer holds.
BUFFER_ROWS = 50_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list<float> column as a 2-d double array without a loop over rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def _by_device(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    devices = batch.column("device_id").to_numpy(zero_copy_only=False)
    for device in np.unique(devices):
        yield int(device), np.nonzero(devices == device)[0]


# ---- training ------------------------------------------------------------


def training_table(rows: DataFrame, *, fleet: bool = False, seed: int = 42) -> DataFrame:
    """Train and val rows spread over tasks in a seeded order, written once.

    ``rows`` has device_id, id, features and split.
    """
    spark = rows.sparkSession
    device = F.lit(FLEET) if fleet else F.col("device_id")
    known = rows.where("split in ('train', 'val')")
    # Averaging over tasks with few steps each learns slowly, so tasks get a fair share of rows.
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(most, -(-known.count() // ROWS_PER_TASK) or 1)
    table = known.select(
        device.cast("int").alias("device_id"),
        "features",
        (F.col("split") == "val").alias("is_val"),
        hash_order(seed, "id").alias("_o"),
    )
    spreadout = table.repartition(parts, "_o").sortWithinPartitions("device_id", "is_val", "_o").drop("_o")
    return staged(spreadout, "ae-training")


class _Buffer:
    """Rows of one device, handed on in shuffled mini-batches of one size whatever the batches they came in."""

    def __init__(self, batch_size: int, rows: int):
        self.batch_size, self.room = batch_size, max(rows, batch_size)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Fills up; yields the content each time the buffer is full."""
        while len(rows):
            take = rows[: self.room - self.held]
            self.parts.append(take)
            self.held += len(take)
            rows = rows[len(take) :]
            if self.held == self.room:
                yield self.content()

    def content(self) -> np.ndarray:
        whole = np.concatenate(self.parts) if self.parts else np.zeros((0, 0))
        self.parts, self.held = [], 0
        return whole


def _epoch_task(models, epoch: int, batch_size: int, seed: int, shuffle: bool, learn: bool, exact: bool, buffer_rows: int):
    """One epoch over a task's rows: local steps (or their gradient) and validation at the start parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local: dict[tuple[int, str], dict] = {}
        buffers: dict[int, _Buffer] = {}
        part = TaskContext.get().partitionId()

        def feed(device: int, rows: np.ndarray) -> None:
            for config, model in models.value.get(device, {}).items():
                mine = local[device, config]
                if exact:
                    _add_gradient(model["spec"], mine, rows)
                else:
                    order = mine["rng"].permutation(len(rows)) if shuffle else np.arange(len(rows))
                    _learn(model["spec"], mine, rows[order], batch_size)

        for batch in batches:
            flags = batch.column("is_val").to_numpy(zero_copy_only=False)
            features = _matrix(batch.column("features"))
            for device, rows in _by_device(batch):
                val, train = features[rows[flags[rows]]], features[rows[~flags[rows]]]
                for number, (config, model) in enumerate(sorted(models.value.get(device, {}).items())):
                    # Tasks draw their own masks and orders; a retried task draws the same again.
                    mine = local.setdefault((device, config), _fresh(model, [seed, epoch, part, device, number]))
                    _validate(model, mine, val)
                if learn and len(train):
                    for full in buffers.setdefault(device, _Buffer(batch_size, buffer_rows)).add(train):
                        feed(device, full)
        for device, buffer in buffers.items():
            if buffer.held:
                feed(device, buffer.content())
        for (device, config), mine in local.items():
            yield from _parts(device, config, mine, learn, exact)

    return run


def _fresh(model: dict, draw: list[int]) -> dict:
    state = {k: model[k].copy() for k in ("params", "m", "v")} | {"t": model["t"], "lr": model["lr"]}
    zero = np.zeros_like(model["params"])
    return {"state": state, "gradient": zero, "rng": np.random.default_rng(draw), "n": 0, "loss": 0.0, "n_val": 0, "val": 0.0}


def _validate(model: dict, mine: dict, val: np.ndarray) -> None:
    if len(val):
        spec = model["spec"]
        y, _ = dense.forward(spec, dense.unpack(spec, model["params"]), val)
        mine["val"] += float(dense.row_errors(spec, val, y, spec["loss"]).sum())
        mine["n_val"] += len(val)


def _learn(spec: dict, mine: dict, train: np.ndarray, batch_size: int) -> None:
    for start in range(0, len(train), batch_size):
        x = train[start : start + batch_size]
        loss, grad = dense.gradients(spec, mine["state"]["params"], x, mine["rng"])
        dense.update(spec, mine["state"], grad)
        mine["loss"] += loss * len(x)
        mine["n"] += len(x)


def _add_gradient(spec: dict, mine: dict, train: np.ndarray) -> None:
    for start in range(0, len(train), ROWS_PER_TASK):
        x = train[start : start + ROWS_PER_TASK]
        loss, grad = dense.gradients(spec, mine["state"]["params"], x, mine["rng"])
        mine["gradient"] += grad * len(x)
        mine["loss"] += loss * len(x)
        mine["n"] += len(x)


def _parts(device: int, config: str, mine: dict, learn: bool, exact: bool) -> Iterator[pa.RecordBatch]:
    """A task's result for one model, its vectors cut into chunks for the average."""
    s = mine["state"]
    vector = np.zeros(0)
    if learn and mine["n"]:
        vector = mine["gradient"] if exact else np.concatenate([s["params"], s["m"], s["v"]]) * mine["n"]
    pieces = [vector[i : i + CHUNK] for i in range(0, len(vector), CHUNK)] or [vector]
    for no, piece in enumerate(pieces):
        head = no == 0
        yield pa.RecordBatch.from_pydict(
            {
                "device_id": pa.array([device], pa.int32()),
                "config_id": [config],
                "chunk": pa.array([no], pa.int32()),
                "n": pa.array([mine["n"] if head else 0], pa.int64()),
                "loss": [mine["loss"] if head else 0.0],
                "n_val": pa.array([mine["n_val"] if head else 0], pa.int64()),
                "val": [mine["val"] if head else 0.0],
                "t": pa.array([s["t"]], pa.int64()),
                "vector": pa.array([piece.tolist()], pa.list_(pa.float64())),
            }
        )


PART_SCHEMA = (
    "device_id int, config_id string, chunk int, n long, loss double, n_val long, val double, t long, vector array<double>"
)


def _add_chunks(pdf):
    """Sum of one chunk over the tasks; a chunk is CHUNK values wide."""
    total = np.sum([v for v in pdf["vector"] if len(v)], axis=0) if any(len(v) for v in pdf["vector"]) else []
    first = pdf.iloc[:1].copy()
    for c in ("n", "loss", "n_val", "val"):
        first[c] = pdf[c].sum()
    first["t"] = pdf["t"].max()
    first["vector"] = [list(total)]
    return first


def _run_epoch(table: DataFrame, models: dict, epoch: int, *options) -> dict:
    """Losses and summed vectors of a wave of models after one pass."""
    shared = table.sparkSession.sparkContext.broadcast(models)
    parts = table.where(F.col("device_id").isin(list(models))).mapInArrow(
        _epoch_task(shared, epoch, *options), PART_SCHEMA
    )
    summed = parts.groupBy("device_id", "config_id", "chunk").applyInPandas(_add_chunks, PART_SCHEMA)
    found: dict[tuple[int, str], dict] = {}
    for r in sorted(summed.collect(), key=lambda r: r["chunk"]):
        got = found.setdefault((r["device_id"], r["config_id"]), {"n": 0, "loss": 0.0, "n_val": 0, "val": 0.0, "vector": []})
        for k in ("n", "loss", "n_val", "val"):
            got[k] += r[k]
        got["t"] = r["t"]
        got["vector"].append(np.asarray(r["vector"]))
    shared.unpersist()
    return found


def train(
    table: DataFrame,
    plan: list[tuple[int, str, dict]],
    *,
    epochs: int = 100,
    batch_size: int = 1024,
    patience: int | None = 10,
    min_delta: float = 1e-5,
    restore_best: bool = True,
    plateau: dict | None = None,
    shuffle: bool = True,
    buffer_rows: int = BUFFER_ROWS,
    exact: bool = False,
    start: dict[tuple[int, str], np.ndarray] | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Trains every (device, config id, config) of the plan; returns (models, history).

    ``exact`` makes each epoch one full-batch step (without batch normalisation, whose moments are those of a
    batch). ``start`` gives first parameters instead of drawn ones.

    Stops a model on NaN or after ``patience`` epochs without the validation
    loss falling by ``min_delta``. ``plateau`` (factor, patience, min_delta,
    min_lr) lowers the learning rate.
    """
    spark = table.sparkSession
    input_dim = len(table.select("features").first()["features"])
    waves, held = [[]], 0
    for device, config_id, config in plan:
        spec = dense.complete(config, input_dim)
        if exact and spec["batch_norm"]:
            raise ValueError("exact training does not know batch normalisation")
        size = 3 * dense.parameter_count(spec)
        if waves[-1] and held + size > WAVE_VALUES:
            waves.append([])
            held = 0
        waves[-1].append((device, config_id, spec))
        held += size
    path = scratch_path(spark, "ae-models")
    for wave in waves:
        models, history = _train_wave(
            table, wave, epochs, patience, min_delta, restore_best, plateau, start or {}, seed, (batch_size, seed, shuffle), (exact, buffer_rows)
        )
        # Finished waves leave the driver.
        spark.createDataFrame(models, MODEL_SCHEMA).write.mode("append").parquet(f"{path}/models")
        spark.createDataFrame(history, HISTORY_SCHEMA).write.mode("append").parquet(f"{path}/history")
    return (
        spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/models"),
        spark.read.schema(HISTORY_SCHEMA).parquet(f"{path}/history"),
    )


def _train_wave(table, wave, epochs, patience, min_delta, restore_best, plateau, first, seed, drawing, mode):
    """Model and history rows of one wave."""
    runs, models, history = {}, [], []
    for device, config_id, spec in wave:
        start = np.array(first.get((device, config_id), dense.initial(spec, seed)), "float64")
        zero = np.zeros_like(start)
        runs[device, config_id] = {
            "spec": spec, "params": start, "m": zero, "v": zero.copy(), "t": 0, "lr": float(spec["learning_rate"]),
            "best": np.inf, "best_params": start, "best_epoch": None, "wait": 0, "cool": 0, "low": np.inf, "open": True, "rows": [],
        }
    # Epoch e's validation loss is measured at the start of pass e + 1.
    for epoch in range(1, epochs + 2):
        live = {k: r for k, r in runs.items() if r["open"]}
        if not live:
            break
        shared: dict = {}
        for (device, config_id), r in live.items():
            shared.setdefault(device, {})[config_id] = {k: r[k] for k in ("spec", "params", "m", "v", "t", "lr")}
        found = _run_epoch(table, shared, epoch, *drawing, epoch <= epochs, *mode)
        for key, r in live.items():
            got = found.get(key)
            if got is None:
                r["open"] = False
                continue
            if epoch > 1:
                _close_epoch(r, got, patience, min_delta, plateau)
            if r["open"] and epoch <= epochs and got["n"]:
                (_take_step if mode[0] else _take_average)(r, got, epoch)
            elif epoch > epochs or not got["n"]:
                r["open"] = False
    for (device, config_id), r in runs.items():
        kept = r["best_params"] if restore_best and r["best_epoch"] else r["params"]
        best = float(r["best"]) if r["best_epoch"] else None
        models.append((device, config_id, json.dumps(r["spec"]), [float(x) for x in kept], r["best_epoch"], best, len(r["rows"])))
        history.extend((device, config_id, *row) for row in r["rows"])
    return models, history


def _take_step(r: dict, got: dict, epoch: int) -> None:
    """One optimiser step by the gradient over all rows."""
    state = {k: r[k] for k in ("params", "m", "v", "t", "lr")}
    state["params"] = state["params"].copy()
    dense.update(r["spec"], state, np.concatenate(got["vector"]) / got["n"])
    r["params"], r["t"] = state["params"], state["t"]
    r["rows"].append([epoch, got["loss"] / got["n"], None, r["lr"]])
    r["open"] = bool(np.isfinite(r["rows"][-1][1]))


def _take_average(r: dict, got: dict, epoch: int) -> None:
    vector = np.concatenate(got["vector"]) / got["n"]
    r["params"], r["m"], r["v"] = (x.copy() for x in np.split(vector, 3))
    r["t"] = got["t"]
    r["rows"].append([epoch, got["loss"] / got["n"], None, r["lr"]])
    if not np.isfinite(r["rows"][-1][1]):
        r["open"] = False


def _close_epoch(r: dict, got: dict, patience: int | None, min_delta: float, plateau: dict | None) -> None:
    """Validation loss of the epoch that just ended, and what follows from it."""
    if not got["n_val"] or not r["rows"]:
        return
    loss = got["val"] / got["n_val"] + dense.penalty(r["spec"], dense.unpack(r["spec"], r["params"]))
    r["rows"][-1][2] = float(loss)
    if not np.isfinite(loss):
        r["open"] = False
        return
    if loss < r["best"] - min_delta:
        r["best"], r["best_params"], r["best_epoch"], r["wait"] = loss, r["params"].copy(), r["rows"][-1][0], 0
    else:
        r["wait"] += 1
        r["open"] = patience is None or r["wait"] < patience
    if plateau:
        if loss < r["low"] - plateau.get("min_delta", 1e-5):
            r["low"], r["cool"] = loss, 0
        else:
            r["cool"] += 1
            floor = plateau.get("min_lr", 1e-6)
            if r["cool"] >= plateau.get("patience", 5) and r["lr"] > floor:
                r["lr"], r["cool"] = max(r["lr"] * plateau.get("factor", 0.5), floor), 0


# ---- use of models -------------------------------------------------------


def model_table(spark: SparkSession, models: list[tuple[int, str, dict, np.ndarray]]) -> DataFrame:
    """A model table from given weights."""
    return spark.createDataFrame(
        [(d, c, json.dumps(s), [float(x) for x in p], None, None, 0) for d, c, s, p in models], MODEL_SCHEMA
    )


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Stored models; reading raises when the path or a column is missing."""
    return spark.read.parquet(path).select("device_id", "config_id", "spec", "params", "best_epoch", "best_val_loss", "epochs_trained")


def _model_waves(models: DataFrame) -> Iterator[dict]:
    """Models by device in dicts of bounded total size, read one wave at a time."""
    wave, held = {}, 0
    for r in models.select("device_id", "config_id", "spec", "params").toLocalIterator():
        if wave and held + len(r["params"]) > WAVE_VALUES:
            yield wave
            wave, held = {}, 0
        wave.setdefault(r["device_id"], {})[r["config_id"]] = (json.loads(r["spec"]), np.asarray(r["params"]))
        held += len(r["params"])
    if wave:
        yield wave


def _apply(rows: DataFrame, models: DataFrame, output: str, schema: str, fn) -> DataFrame:
    """Runs fn(spec, layers, x) for each row and each model of its device.

    A model of device 0 is the fleet's and serves all rows.
    """
    rows = _with_model(rows, models)
    kept = [f for f in rows.schema.fields if f.name != "features"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    outputs = []
    for wave in _model_waves(models):
        shared = rows.sparkSession.sparkContext.broadcast(wave)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x = _matrix(batch.column("features"))
                names = [f.name for f in kept]
                for device, at in _by_device(batch):
                    for config, (spec, params) in {**shared.value.get(FLEET, {}), **shared.value.get(device, {})}.items():
                        result = fn(spec, dense.unpack(spec, params), x[at])
                        part = batch.select(names).take(pa.array(at))
                        column = (
                            pa.array(result.astype("float32"))
                            if result.ndim == 1
                            else pa.FixedSizeListArray.from_arrays(pa.array(result.astype("float32").ravel()), result.shape[1]).cast(pa.list_(pa.float32()))
                        )
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array([config] * len(at)), column], names=[*names, "config_id", output]
                        )

        # Later waves pass over the rows of their devices only; the first also meets those that no model serves.
        served = rows if FLEET in wave or not outputs else rows.where(F.col("device_id").isin(list(wave)))
        outputs.append(served.mapInArrow(run, f"{fields}, config_id string, {output} {schema}"))
    if not outputs:
        raise ValueError("no models to apply")
    return reduce(DataFrame.unionByName, outputs)


def _with_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows``; a row whose device no model serves is an error."""
    served = models.select("device_id").distinct()
    if not served.where(F.col("device_id") == FLEET).isEmpty():
        return rows
    found = lookup_join(rows, served.withColumn("_served", F.lit(True)), ["device_id"], "left")
    return found.where(required("_served", "model", "device_id")).drop("_served").select(*rows.columns)


def ae_reconstruct(rows: DataFrame, models: DataFrame) -> DataFrame:
    return _apply(rows, models, "reconstruction", "array<float>", lambda s, p, x: dense.forward(s, p, x)[0])


def ae_encode(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Latent vectors (after normalisation and activation of the latent layer)."""
    return _apply(rows, models, "latent", "array<float>", lambda s, p, x: dense.forward(s, p, x, upto=len(s["hidden_dims"]) + 1)[0])


def ae_score(rows: DataFrame, models: DataFrame, error: str | None = None) -> DataFrame:
    """Reconstruction error per row: mse, mae or rmse, by default the model's own."""
    if error is not None and error not in dense.ERRORS:
        raise ValueError(f"invalid reconstruction error {error!r}, expected one of {sorted(dense.ERRORS)}")

    def score(spec, layers, x):
        return dense.row_errors(spec, x, dense.forward(spec, layers, x)[0], error or spec["reconstruction_error"])

    return _apply(rows, models, "score", "float", score)


# ---- screening and search ------------------------------------------------


def screening(rows: DataFrame, configs: dict[str, dict], devices: list[int], **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trains devices x configs; returns (summary, models, history).

    The summary has the score summary of train and val next to the best epoch.
    """
    fleet = devices == [FLEET]
    models, history = train(
        training_table(rows, fleet=fleet), [(d, c, cfg) for d in devices for c, cfg in configs.items()], **options
    )
    known = rows.where("split in ('train', 'val')").select("device_id", "id", "split", "features")
    scores = staged(ae_score(known, models), "ae-screening")
    if fleet:
        scores = scores.withColumn("device_id", F.lit(FLEET))
    summary = score_summary(scores, ["device_id", "config_id", "split"])
    epochs = best_epoch(history, ["device_id", "config_id"])
    return summary.join(epochs, ["device_id", "config_id"]), models, history


def suggest(space: dict[str, dict], n: int, seed: int = 42) -> list[dict]:
    """n seeded random candidates: choices, integer or float ranges, optionally in log scale."""
    rng = np.random.default_rng(seed)
    found = []
    for number in range(n):
        params = {"number": number}
        for name, s in space.items():
            if "choices" in s:
                params[name] = s["choices"][int(rng.integers(len(s["choices"])))]
                continue
            if "low" not in s or "high" not in s:
                raise ValueError(f"search space of {name!r} needs 'choices' or 'low' and 'high'")
            low, high, log = s["low"], s["high"], bool(s.get("log", False))
            if log and float(low) <= 0:
                raise ValueError(f"log search space of {name!r} needs low > 0")
            whole = isinstance(low, int) and isinstance(high, int) and not s.get("float", False)
            if log:
                value = float(np.exp(rng.uniform(np.log(low), np.log(high + 1 if whole else high))))
            else:
                value = rng.uniform(low, high + 1 if whole else high)
            params[name] = min(int(value), high) if whole else float(value)
        found.append(params)
    return found


def sweep(
    rows: DataFrame, fixed: dict, candidates: list[dict], devices: list[int], *, quantile: float = 0.99, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All candidates of all devices in parallel; returns (trials, best per device, models).

    The objective is a high quantile of the benign validation scores.
    """
    if not 0 < quantile < 1:
        raise ValueError("the objective quantile must lie between 0 and 1")
    fleet, spark = devices == [FLEET], rows.sparkSession
    plan = [
        (d, str(c["number"]), {**fixed, **{k: v for k, v in c.items() if k != "number"}}) for d in devices for c in candidates
    ]
    models, _ = train(training_table(rows, fleet=fleet), plan, **options)
    val = rows.where("split = 'val'").select("device_id", "id", "features")
    scores = staged(ae_score(val, models), "ae-sweep")
    if fleet:
        scores = scores.withColumn("device_id", F.lit(FLEET))
    values = quantiles(scores, ["device_id", "config_id"], "score", {"value": quantile})
    params = spark.createDataFrame(
        [(c["number"], json.dumps({k: v for k, v in c.items() if k != "number"})) for c in candidates], "number int, params string"
    )
    # The candidate list is an argument of the call.
    trials = values.withColumn("number", F.col("config_id").cast("int")).drop("config_id").join(F.broadcast(params), "number")
    return trials, best_trial(trials, ["device_id"], ["params"]), models
