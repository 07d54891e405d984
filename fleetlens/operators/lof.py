"""Local Outlier Factor for novelty scoring, on top of the neighbour join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.operators.joins import lookup_join, required
from fleetlens.operators.neighbors import knn_join
from fleetlens.operators.ordering import quantiles
from fleetlens.operators.records import best_trial
from fleetlens.session import staged

# Fixed value: keeps the density of coinciding points finite.
EPSILON = 1e-10
# Column that tells the train rows among the queries of a sweep.
TRAINS = "is_train"
MODEL_COLUMNS = ["device_id", "id", "features", "kdist", "lrd", "n_neighbors"]


def _reach(edges: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """Neighbour edges with the neighbour's model values and reachability distance.

    A point may be everyone's neighbour, hence the join that is safe for hot keys.
    """
    joined = lookup_join(edges, points.withColumnRenamed("id", "nid"), [*by, "nid"])
    return joined.withColumn("reach", F.greatest("dist", "nb_kdist"))


def _density() -> Column:
    return F.lit(1.0) / (F.avg("reach") + F.lit(EPSILON))


def _edges(neighbors: DataFrame, by: list[str]) -> DataFrame:
    """One row per neighbour; a point without any is an error, as its device has no other train rows."""
    nobody = F.raise_error(F.concat(F.lit("no neighbours for device "), F.col("device_id").cast("string")))
    answered = F.when(F.size("neighbors") > 0, F.col("neighbors")).otherwise(nobody)
    found = neighbors.withColumn("neighbors", answered).select(*by, "id", F.posexplode("neighbors").alias("pos", "nb"))
    return found.select(*by, "id", "pos", F.col("nb.dist").alias("dist"), F.col("nb.id").alias("nid"))


def densities(neighbors: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, kdist, lrd, n_neighbors) from the neighbour lists of the train points."""
    kdist = neighbors.select(
        *by, "id", F.element_at("neighbors", -1)["dist"].alias("kdist"), F.size("neighbors").alias("n_neighbors")
    )
    reach = _reach(_edges(neighbors, by), kdist.select(*by, "id", F.col("kdist").alias("nb_kdist")), by)
    return reach.groupBy(*by, "id").agg(_density().alias("lrd")).join(kdist, [*by, "id"])


def outlier_factors(neighbors: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, score): mean density of the neighbours over the own density."""
    points = model.select(
        *by, "id", F.col("kdist").alias("nb_kdist"), F.col("lrd").alias("nb_lrd"), F.col("n_neighbors").alias("used")
    )
    reach = _reach(_edges(neighbors, by), points, by).where("pos < used")
    return reach.groupBy(*by, "id").agg((F.avg("nb_lrd") / _density()).alias("score"))


def lof_fit(train: DataFrame, n_neighbors: int = 20, metric: str = "euclidean") -> DataFrame:
    """The model table: train points with k-distance and local reachability density."""
    neighbors = staged(knn_join(train, train, n_neighbors, metric=metric, exclude_self=True), "lof-neighbors")
    fitted = densities(neighbors, ["device_id"])
    return fitted.join(train.select("device_id", "id", "features"), ["device_id", "id"]).select(*MODEL_COLUMNS)


def lof_score(queries: DataFrame, model: DataFrame, n_neighbors: int = 20, metric: str = "euclidean") -> DataFrame:
    """(device_id, id, score); high is anomalous. Train rows are scored like new ones."""
    neighbors = staged(knn_join(queries, model, n_neighbors, metric=metric), "lof-query-neighbors")
    return outlier_factors(neighbors, model, ["device_id"])


def save_model(model: DataFrame, path: str) -> None:
    """Writes a model table; what a refit adds is kept."""
    extra = [c for c in ("metric", "k") if c in model.columns]
    model.select(*MODEL_COLUMNS, *extra).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """A stored model; a table of another kind is an error."""
    table = spark.read.parquet(path)
    missing = [c for c in MODEL_COLUMNS if c not in table.columns]
    if missing:
        raise TypeError(f"not a density model, missing columns {missing}")
    return table.select(*MODEL_COLUMNS, *[c for c in ("metric", "k") if c in table.columns])


def _at_own_k(neighbors: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Lists cut to the k of their device (``chosen`` has by and n_neighbors)."""
    found = lookup_join(neighbors, chosen.select(*by, "n_neighbors"), by)
    return found.withColumn("neighbors", F.slice("neighbors", F.lit(1), F.col("n_neighbors"))).drop("n_neighbors")


def _metrics(chosen: DataFrame) -> list[tuple[str, int]]:
    """(metric, largest k) of a table of choices; the metrics are few by name."""
    rows = chosen.groupBy("metric").agg(F.max("n_neighbors").alias("k")).orderBy("metric").collect()
    return [(r["metric"], r["k"]) for r in rows]


def lof_refit(train: DataFrame, best: DataFrame, lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """One model table for all devices, each fitted with its own k and metric.

    ``best`` has device_id, n_neighbors and metric (see ``lof_sweep``). The model table has ``metric`` and
    ``k`` beside the usual columns. Each metric takes one neighbour join at its largest k over its devices;
    a device's lists are prefixes; ``lists`` of a sweep over the same rows spare it. A device without a choice is an error.
    """
    by, models = ["device_id"], []
    choice = lookup_join(train, best.select(*by, F.col("metric").alias("_metric")), by, "left")
    checked_rows = choice.withColumn("_metric", required("_metric", "trial", "device_id"))
    for metric, widest in _metrics(best):
        rows = checked_rows.where(F.col("_metric") == metric).select(*by, "id", "features")
        if metric not in (lists or {}):
            found = knn_join(rows, rows, widest, metric=metric, exclude_self=True)
        else:
            found = lookup_join(lists[metric], best.where(F.col("metric") == metric).select(*by), by)
        own = staged(_at_own_k(found, best, by), "refit-neighbors")
        fitted = densities(own, by).join(rows, [*by, "id"]).select(*MODEL_COLUMNS, F.lit(metric).alias("metric"))
        models.append(lookup_join(fitted, best.select(*by, F.col("n_neighbors").alias("k")), by))
    if not models:
        raise ValueError("no best trials to refit")
    return reduce(DataFrame.unionByName, models)


def lof_rescore(queries: DataFrame, model: DataFrame) -> DataFrame:
    """(device_id, id, score) by the models of ``lof_refit``; each device by its own k and metric."""
    by, scored = ["device_id"], []
    chosen = staged(model.select(*by, "metric", F.col("k").alias("n_neighbors")).distinct(), "rescore-choices")
    routed = lookup_join(queries, chosen.select(*by, "metric"), by, "left")
    routed = routed.withColumn("metric", required("metric", "model", "device_id"))
    for metric, widest in _metrics(chosen):
        own = model.where(F.col("metric") == metric)
        rows = routed.where(F.col("metric") == metric).select(*by, "id", "features")
        lists = staged(_at_own_k(knn_join(rows, own.select(*by, "id", "features"), widest, metric=metric), chosen, by), "rescore-neighbors")
        scored.append(outlier_factors(lists, own, by))
    return reduce(DataFrame.unionByName, scored)


def _densities_by_k(neighbors: DataFrame, ks: list[int]) -> DataFrame:
    """(device_id, id, kdist_<k>, lrd_<k>, used_<k>) for several k: ``densities`` of all prefixes in one pass over the edges."""
    by, size = ["device_id"], F.size("neighbors")
    kdist = neighbors.select(
        *by,
        "id",
        *[F.element_at("neighbors", F.least(F.lit(k), size))["dist"].alias(f"kdist_{k}") for k in ks],
        *[F.least(F.lit(k), size).alias(f"used_{k}") for k in ks],
    )
    points = kdist.select(*by, F.col("id").alias("nid"), *[f"kdist_{k}" for k in ks])
    edges = lookup_join(_edges(neighbors, by), points, [*by, "nid"])
    reach = {k: F.avg(F.when(F.col("pos") < k, F.greatest("dist", f"kdist_{k}"))) for k in ks}
    lrd = edges.groupBy(*by, "id").agg(*[(F.lit(1.0) / (r + F.lit(EPSILON))).alias(f"lrd_{k}") for k, r in reach.items()])
    return lrd.join(kdist, [*by, "id"])


def _factors_by_k(neighbors: DataFrame, model: DataFrame, ks: list[int]) -> DataFrame:
    """(device_id, id, score_<k>) by a model of ``_densities_by_k``: ``outlier_factors`` of all prefixes in one pass."""
    by = ["device_id"]
    edges = lookup_join(_edges(neighbors, by), model.withColumnRenamed("id", "nid"), [*by, "nid"])

    def factor(k: int) -> Column:
        counts = (F.col("pos") < k) & (F.col("pos") < F.col(f"used_{k}"))
        reach = F.avg(F.when(counts, F.greatest("dist", f"kdist_{k}")))
        return (F.avg(F.when(counts, F.col(f"lrd_{k}"))) / (F.lit(1.0) / (reach + F.lit(EPSILON)))).alias(f"score_{k}")

    return edges.groupBy(*by, "id").agg(*[factor(k) for k in ks])


def lof_sweep(
    train: DataFrame, val: DataFrame, candidates: list[dict], *, quantile: float = 0.99, lists: dict[str, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All candidates at once: (trials, best trial per device).

    A candidate has number, n_neighbors and metric. Each metric needs a single
    neighbour join at its largest k; smaller k are prefixes of its lists. ``lists``
    receives those of the train rows by metric, for ``lof_refit``. The
    objective is a high quantile of the benign validation scores; values that agree to nine decimals are ties.
    """
    if not 0 < quantile < 1:
        raise ValueError("the objective quantile must lie between 0 and 1")
    spark, by, scored = train.sparkSession, ["device_id", "number"], []
    asked = train.withColumn(TRAINS, F.lit(True)).unionByName(val.withColumn(TRAINS, F.lit(False)))
    for metric in sorted({c["metric"] for c in candidates}):
        mine = [c for c in candidates if c["metric"] == metric]
        widest = max(c["n_neighbors"] for c in mine)
        # One join answers train and validation rows.
        found = staged(knn_join(asked, train, widest, metric=metric, exclude_self=TRAINS), "sweep-neighbors")
        inner, outer = found.where(TRAINS).drop(TRAINS), found.where(~F.col(TRAINS)).drop(TRAINS)
        ks = sorted({c["n_neighbors"] for c in mine})
        model = staged(_densities_by_k(inner, ks), "sweep-model")
        numbers = F.array(*[F.struct(F.lit(c["number"]).alias("number"), F.col(f"score_{c['n_neighbors']}").alias("score")) for c in mine])
        scored.append(_factors_by_k(outer, model, ks).select("device_id", "id", F.inline(numbers)))
        if lists is not None:
            lists[metric] = inner
    scores = staged(reduce(DataFrame.unionByName, scored), "sweep-scores")
    params = spark.createDataFrame(
        [(c["number"], c["n_neighbors"], c["metric"]) for c in candidates], "number int, n_neighbors int, metric string"
    )
    # The candidate list is an argument of the call.
    values = quantiles(scores, by, "score", {"value": quantile}).withColumn("value", F.round("value", 9))
    trials = values.join(F.broadcast(params), "number")
    return trials, best_trial(trials, ["device_id"], ["n_neighbors", "metric"])
