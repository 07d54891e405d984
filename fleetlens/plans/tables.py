"""Named queries over sources, profiles, samples and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.operators import comparison, evaluation, preparation, profiling, records, sampling, scaling, thresholds as th
from fleetlens.operators.joins import with_scalars
from fleetlens.plans import bindings as b
from fleetlens.session import scratch_path, staged
from fleetlens.sources import traffic as src

DUP_FEATURES = ["quantity", "discount", "tax"]
EXTREME_DEVICES = [2, 3, 7]
# Candidate grids of the supervised thresholds, prevalences of the precision-recall curves.
MCC_GRID = {"n_candidates": 1000, "min_quantile": 0.0, "max_quantile": 0.3}
AE_GRID = {"n_candidates": 2000, "min_quantile": 0.0, "max_quantile": 0.5}
FLEET_GRID = {"n_candidates": 100, "min_quantile": 0.0, "max_quantile": 0.5}
PR_PREVALENCES = [0.10, 0.001]


def stable(df: DataFrame) -> DataFrame:
    """Doubles rounded half up to nine significant digits, so that summation order does not show."""

    def rounded(x: Column) -> Column:
        size = F.abs(x)
        digits = F.lit(8) - F.floor(F.log10(size))
        # Powers of ten with whole, positive exponents are exact.
        up, down = F.pow(F.lit(10.0), F.greatest(digits, F.lit(0))), F.pow(F.lit(10.0), F.greatest(-digits, F.lit(0)))
        near = F.floor(size * up / down + 0.5).cast("double") * down / up * F.signum(x)
        return F.when((size > 0) & (size < float("inf")), near).otherwise(x)

    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.select(*[rounded(F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


# ---- sources -------------------------------------------------------------


def _raw_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "raw-csv")
    src.write_raw_csv(b.traffic(spark, sf_dir, "double").select(*b.FEATURES, b.file_name().alias("file_name")), path)
    return path


def scan_csv(spark, sf_dir):
    scanned = src.scan_csv(spark, _raw_csv(spark, sf_dir), b.FEATURES)
    sums = [F.round(F.sum(f), 2).alias(f"sum_{f}") for f in b.FEATURES]
    return scanned.groupBy("file_name").agg(F.count("*").alias("n"), *sums)


def label_from_filename(spark, sf_dir):
    return b.file_summary(spark, sf_dir).select("file_name", src.file_labels(F.col("file_name")).alias("l")).select(
        "file_name", "l.*"
    )


def ingest_by_device(spark, sf_dir):
    path = scratch_path(spark, "ingest")
    src.write_traffic(src.label_rows(src.scan_csv(spark, _raw_csv(spark, sf_dir), b.FEATURES)), path)
    sums = [F.round(F.sum(F.col(f).cast("double")), 2).alias(f"sum_{f}") for f in b.FEATURES]
    stored = spark.read.parquet(path)
    return stored.groupBy("device_id", "is_attack", "attack_family", "attack_type").agg(F.count("*").alias("n"), *sums)


def ingest_wide(spark, sf_dir):
    """The ingest variant that keeps doubles, replacing the folder as a whole."""
    path = scratch_path(spark, "ingest-wide")
    src.write_traffic(src.label_rows(src.scan_csv(spark, _raw_csv(spark, sf_dir), b.FEATURES), as_float=False), path, whole=True)
    stored = spark.read.parquet(path)
    sums = [F.round(F.sum(f), 2).alias(f"sum_{f}") for f in b.FEATURES]
    return stored.groupBy("device_id", "is_attack", "attack_family", "attack_type").agg(F.count("*").alias("n"), *sums)


def prepare_run(spark, sf_dir):
    """The whole prepare job: rows of every stage, and the moments of the scaled train splits."""
    stages = preparation.prepare(spark, _raw_csv(spark, sf_dir), b.FEATURES, scratch_path(spark, "prepare"))
    read = lambda name: spark.read.parquet(stages.paths[name]).withColumn("device_id", F.col("device_id").cast("int"))
    none = F.lit(None).cast("double")
    total = F.round(F.sum(F.col("quantity").cast("double")), 2).alias("sum_quantity")

    def scaled(name: str, device) -> DataFrame:
        train = F.col("split") == "train"
        means = sum((F.abs(F.avg(F.col(f).cast("double"))) for f in b.FEATURES[1:]), F.abs(F.avg(F.col(b.FEATURES[0]).cast("double"))))
        spreads = sum((F.stddev_pop(F.col(f).cast("double")) for f in b.FEATURES[1:]), F.stddev_pop(F.col(b.FEATURES[0]).cast("double")))
        rows = read(name).groupBy(device.alias("device_id"), "split").agg(F.count("*").alias("n"), none.alias("sum_quantity"), means.alias("m"), spreads.alias("s"))
        when = lambda c: F.when(train, unsigned_zero(F.round(F.col(c) / len(b.FEATURES), 4)))
        return rows.select(F.lit(name).alias("stage"), "device_id", "split", "n", "sum_quantity", when("m").alias("train_mean"), when("s").alias("train_std"))

    plain = [
        read(name).groupBy("device_id", split.alias("split")).agg(F.count("*").alias("n"), total).select(F.lit(name).alias("stage"), "*", none.alias("train_mean"), none.alias("train_std"))
        for name, split in (("base", F.lit("all")), ("splits", F.col("split")))
    ]
    plain[1] = plain[1].withColumn("sum_quantity", none)
    return plain[0].unionByName(plain[1]).unionByName(scaled("scaled_device", F.col("device_id"))).unionByName(scaled("scaled_fleet", F.lit(0)))


def _summary_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "summary")
    table = b.file_summary(spark, sf_dir).select(
        F.concat(F.lit(" "), "file_name").alias("File Name"),
        F.col("n_samples").alias(" Data Count"),
        F.col("n_features").alias(" Feature Count"),
    )
    table.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


def file_manifest(spark, sf_dir):
    return src.file_manifest(spark, _summary_csv(spark, sf_dir))


def _catalog(spark, sf_dir) -> DataFrame:
    return src.build_file_catalog(b.file_summary(spark, sf_dir), b.device_names(spark, sf_dir))


def file_catalog(spark, sf_dir):
    summary = src.read_summary(spark, _summary_csv(spark, sf_dir))
    return src.build_file_catalog(summary, b.device_names(spark, sf_dir))


def scan_projected(spark, sf_dir):
    return src.scan_projected(spark, f"{sf_dir}/lineitem.parquet", ["l_quantity", "l_discount"])


def scores_with_metadata(spark, sf_dir):
    path = scratch_path(spark, "scores")
    src.write_scores_with_metadata(b.scored(spark, sf_dir), ["row_key", "device_id", "is_attack", "attack_family", "attack_type"], path)
    return spark.read.parquet(path)


def split_counts(spark, sf_dir):
    path = scratch_path(spark, "splits")
    src.write_splits(_splits(spark, sf_dir), path)
    return src.split_counts(spark.read.parquet(path))


def artifact_sizes(spark, sf_dir):
    return src.artifact_sizes(spark, sf_dir, "*.parquet")


RUN_SCHEMA = "experiment string, summary struct<n_rows:bigint, n_attack:bigint, families:map<string,bigint>>, device_id int"


def run_summary_scan(spark, sf_dir):
    """Nested summaries written as one JSON document per device and read back."""
    per_family = b.predictions(spark, sf_dir).groupBy("device_id", "attack_family").agg(F.count("*").alias("n"))
    documents = per_family.groupBy("device_id").agg(
        F.lit("fleet").alias("experiment"),
        F.struct(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("attack_family") != "benign", F.col("n"))), F.lit(0)).alias("n_attack"),
            F.map_from_entries(F.collect_list(F.struct("attack_family", "n"))).alias("families"),
        ).alias("summary"),
    )
    path = scratch_path(spark, "runs")
    src.write_run_summaries(documents, path)
    return src.read_run_summaries(spark, path, RUN_SCHEMA).select(
        "experiment", "n_devices", F.concat(F.lit("device_"), F.col("device_id").cast("string")).alias("device"),
        "summary.n_rows", "summary.n_attack", F.col("summary.families")["gafgyt"].alias("n_gafgyt"),
    )


def union_devices(spark, sf_dir):
    path = scratch_path(spark, "per-device")
    base = b.predictions(spark, sf_dir)
    base.write.partitionBy("device_id").parquet(path)
    return src.read_devices(spark, path).select("row_key", "score", "y_true", "y_pred", "device")


def history_scan(spark, sf_dir):
    path = scratch_path(spark, "history")
    table = b.history(spark, sf_dir).withColumn("device", F.concat(F.lit("device_"), F.col("device_id").cast("string")))
    table.select("device", "model_id", "epoch", "loss", "val_loss").write.option("header", True).partitionBy("device", "model_id").csv(path)
    return src.scan_histories(spark, path)


# ---- projections and predicates ------------------------------------------


def filter_benign(spark, sf_dir):
    return b.traffic(spark, sf_dir).where(~F.col("is_attack")).select("row_key", "device_id", "attack_type")


def apply_threshold(spark, sf_dir):
    return b.alerts(spark, sf_dir).select("event_id", "score", th.predict(F.col("score"), F.lit(50.01)).alias("y_pred"))


def threshold_lookup(spark, sf_dir):
    rows = th.with_threshold(b.alerts(spark, sf_dir), b.thresholds(spark))
    return rows.select("event_id", "device_id", "threshold")


def repredict(spark, sf_dir):
    other = b.thresholds(spark, {d: t - 0.5 for d, t in b.CURRENT_THRESHOLDS.items()})
    rows = th.apply_thresholds(b.predictions(spark, sf_dir), other)
    return rows.groupBy("device_id", "y_true", "y_pred").agg(F.count("*").alias("n"))


def score_group(spark, sf_dir):
    return b.predictions(spark, sf_dir).select("row_key", th.score_group().alias("score_group"))


def parse_label(spark, sf_dir):
    label = F.concat(F.lit("device_"), F.col("device_id").cast("string"), F.lit(" - "), F.col("attack_family"))
    rows = b.traffic(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    device, number, family = profiling.split_label(F.col("label"))
    return rows.select("label", device.alias("device"), number.alias("device_id"), family.alias("family"), "n")


def feature_grammar(spark, sf_dir):
    """Feature dimension with the mean of every feature."""
    rows = b.windowed(spark, sf_dir)
    means = rows.agg(*[F.avg(c).alias(c) for c in b.WINDOW_FEATURES]).unpivot([], b.WINDOW_FEATURES, "feature", "mean")
    return stable(profiling.feature_dimension(spark, b.WINDOW_FEATURES).join(means, "feature"))


def _strategies(spark, sf_dir) -> DataFrame:
    tables = {s: b.predictions(spark, sf_dir, s) for s in b.STRATEGIES}
    for s in b.STRATEGIES[1:]:
        tables[s] = tables[s].withColumnRenamed("score", "reconstruction_error")
    tables["AE global"] = tables["AE global"].withColumn("device_id", F.col("device_id").cast("string"))
    return comparison.unify(tables)


def _stored_strategies(spark, sf_dir) -> DataFrame:
    return staged(_strategies(spark, sf_dir), "strategies")


def strategy_union(spark, sf_dir):
    return _strategies(spark, sf_dir).select("strategy", "row_key", "device_id", "score", "y_true", "y_pred")


# ---- splits and samples --------------------------------------------------


def _stored_traffic(spark, sf_dir) -> DataFrame:
    """The ingested table that later stages read several times."""
    return staged(b.traffic(spark, sf_dir), "traffic")


def _splits(spark, sf_dir) -> DataFrame:
    return sampling.split_benign(_stored_traffic(spark, sf_dir), "row_key")


def split_benign(spark, sf_dir):
    return _splits(spark, sf_dir).where(~F.col("is_attack")).select("row_key", "device_id", "split")


def device_splits(spark, sf_dir):
    return _splits(spark, sf_dir).groupBy("device_id", "split", "attack_family").agg(F.count("*").alias("n"))


def global_splits(spark, sf_dir):
    return _splits(spark, sf_dir).select("row_key", "device_id", "split", "attack_family", "attack_type")


def sample_exact(spark, sf_dir):
    return sampling.sample_exact(_stored_traffic(spark, sf_dir), "row_key", 0.05).select("row_key", "device_id")


def sample_stratified(spark, sf_dir):
    picked = sampling.sample_exact(_stored_traffic(spark, sf_dir), "row_key", 0.005, group=["device_id"])
    return picked.select("row_key", F.col("device_id").alias("device"))


def prevalence_resample(spark, sf_dir):
    counts = sampling.prevalence_counts(_stored_predictions(spark, sf_dir), "row_key", b.PREVALENCES, repeats=30)
    return counts.select("prevalence", "repeat", "n_attack", "tp", "fp", "tn", "fn")


def prevalence_sample(spark, sf_dir):
    picked = sampling.prevalence_sample(_stored_predictions(spark, sf_dir), "row_key", 0.05)
    return picked.select("row_key", "y_true", "y_pred", "score")


def _split_scores(spark, sf_dir, strategy: str = "LOF") -> DataFrame:
    scores = staged(b.scored(spark, sf_dir, strategy), "scores")
    return staged(sampling.split_benign(scores, "row_key"), "split-scores", ["split"])


def _val_scores(spark, sf_dir, strategy: str = "LOF") -> DataFrame:
    return _split_scores(spark, sf_dir, strategy).where("split = 'val'")


def bootstrap_threshold(spark, sf_dir):
    return stable(
        sampling.bootstrap_stability(
            _val_scores(spark, sf_dir), ["device_id"], "score", {"P99": 0.99, "P99.5": 0.995, "P99.9": 0.999}
        )
    )


def bootstrap_cv(spark, sf_dir):
    """Variation of the bootstrapped thresholds, device by criterion."""
    criteria = {"P99": 0.99, "P99_5": 0.995, "P99_9": 0.999}
    table = sampling.bootstrap_stability(_val_scores(spark, sf_dir), ["device_id"], "score", criteria)
    return stable(th.criteria_pivot(table, list(criteria), "cv_threshold"))


# ---- profiles ------------------------------------------------------------


def structural_summary(spark, sf_dir):
    return profiling.structural_summary(_catalog(spark, sf_dir), len(b.FEATURES))


def class_distribution(spark, sf_dir):
    return stable(profiling.class_distribution(_catalog(spark, sf_dir)))


def device_class_pivot(spark, sf_dir):
    return profiling.device_class_pivot(_catalog(spark, sf_dir))


def family_share(spark, sf_dir):
    return stable(profiling.family_share(_catalog(spark, sf_dir)))


def attack_type_totals(spark, sf_dir):
    return profiling.attack_type_totals(_catalog(spark, sf_dir))


def device_family_pivot(spark, sf_dir):
    return profiling.device_family_pivot(_catalog(spark, sf_dir), b.FAMILIES)


def missing_profile(spark, sf_dir):
    return stable(profiling.missing_profile(b.traffic(spark, sf_dir)))


def _dup_query(keys):
    def query(spark, sf_dir):
        return profiling.duplicate_mask(_stored_traffic(spark, sf_dir), keys).select("row_key", "is_duplicate")

    return query


dup_public = _dup_query(DUP_FEATURES + ["device_id", "attack_family", "attack_type"])
dup_device = _dup_query(DUP_FEATURES + ["device_id"])
dup_global = _dup_query(DUP_FEATURES)


def duplicate_summary(spark, sf_dir):
    return profiling.duplicate_summary(b.traffic(spark, sf_dir), DUP_FEATURES + ["device_id", "attack_family", "attack_type"])


def duplicate_summary_device(spark, sf_dir):
    return profiling.duplicate_summary(b.traffic(spark, sf_dir), DUP_FEATURES + ["device_id"])


def duplicate_summary_global(spark, sf_dir):
    return profiling.duplicate_summary(b.traffic(spark, sf_dir), ["extendedprice", *DUP_FEATURES[:2]])


def duplicate_pivot(spark, sf_dir):
    return profiling.duplicate_pivot(duplicate_summary_device(spark, sf_dir), b.FAMILIES)


def _profiled(spark, sf_dir) -> DataFrame:
    return staged(b.windowed(spark, sf_dir), "windowed")


def feature_variance(spark, sf_dir):
    rows = profiling.feature_variance(b.windowed(spark, sf_dir), b.WINDOW_FEATURES)
    return stable(profiling.both_ends(rows, "variance", 5))


def constant_features(spark, sf_dir):
    return profiling.constant_features(b.windowed(spark, sf_dir), b.WINDOW_FEATURES)


def low_variance_profile(spark, sf_dir):
    return stable(profiling.low_variance_profile(_profiled(spark, sf_dir), b.WINDOW_FEATURES))


def scale_profile(spark, sf_dir):
    return stable(profiling.scale_profile(_profiled(spark, sf_dir), b.WINDOW_FEATURES))


def range_topk(spark, sf_dir):
    rows = profiling._per_column(
        b.windowed(spark, sf_dir), b.WINDOW_FEATURES, {"min": F.min, "max": F.max}
    ).withColumn("range", F.col("max") - F.col("min"))
    return stable(profiling.both_ends(rows, "range", 5))


def iqr_topk(spark, sf_dir):
    rows = profiling.scale_profile(_profiled(spark, sf_dir), b.WINDOW_FEATURES).select("feature", "q1", "q3", "iqr")
    return stable(profiling.both_ends(rows, "iqr", 5))


def window_correlation(spark, sf_dir):
    return stable(profiling.window_correlation(_profiled(spark, sf_dir), b.WINDOW_FEATURES))


def feature_correlation(spark, sf_dir):
    return stable(profiling.feature_correlation(_profiled(spark, sf_dir), b.WINDOW_FEATURES))


# ---- scores and thresholds -----------------------------------------------


def score_summary(spark, sf_dir):
    scores = _split_scores(spark, sf_dir).where("split in ('train', 'val')")
    return stable(th.score_summary(scores, ["device_id", "split"]))


def boxplot_stats(spark, sf_dir):
    scores = _split_scores(spark, sf_dir).where("split in ('train', 'val')")
    return stable(th.boxplot_stats(scores, ["device_id", "split"]))


def ks_train_val(spark, sf_dir):
    return stable(th.ks_report(_split_scores(spark, sf_dir), ["device_id"]))


def ks_train_val_global(spark, sf_dir):
    return stable(th.ks_report(_split_scores(spark, sf_dir, "AE global"), []))


def _criteria(spark, sf_dir) -> DataFrame:
    return th.threshold_criteria(_val_scores(spark, sf_dir), ["device_id"])


def threshold_criteria(spark, sf_dir):
    names = ["p99", "p99_5", "p99_9", "iqr_1_5", "iqr_3"]
    return stable(th.criteria_pivot(_criteria(spark, sf_dir), names, "threshold"))


def threshold_fpr(spark, sf_dir):
    return stable(th.threshold_fpr(_val_scores(spark, sf_dir), _criteria(spark, sf_dir), ["device_id"]))


def threshold_criteria_reconstruction(spark, sf_dir):
    val = _val_scores(spark, sf_dir, "AE per device")
    table = th.threshold_criteria(val, ["device_id"], kind="reconstruction")
    return stable(th.threshold_fpr(val, table, ["device_id"]))


def threshold_criteria_fleet(spark, sf_dir):
    val = _val_scores(spark, sf_dir, "AE global")
    table = th.threshold_fpr(val, th.threshold_criteria(val, [], kind="fleet"), [])
    return stable(table.withColumn("fpr_percent", F.bround("fpr_percent", 2)))


# ---- evaluation ----------------------------------------------------------


def confusion_matrix(spark, sf_dir):
    return stable(evaluation.confusion_matrix(b.predictions(spark, sf_dir)))


def global_metrics(spark, sf_dir):
    return evaluation.global_metrics(b.predictions(spark, sf_dir))


def device_metrics(spark, sf_dir):
    return evaluation.device_metrics(b.predictions(spark, sf_dir))


def family_metrics(spark, sf_dir):
    return evaluation.family_metrics(b.predictions(spark, sf_dir))


def type_metrics(spark, sf_dir):
    return evaluation.type_metrics(b.predictions(spark, sf_dir))


def extreme_type_metrics(spark, sf_dir):
    return evaluation.extreme_type_metrics(b.predictions(spark, sf_dir), EXTREME_DEVICES)


def extreme_recall_pivot(spark, sf_dir):
    return evaluation.extreme_recall_pivot(extreme_type_metrics(spark, sf_dir), EXTREME_DEVICES)


def _stored_predictions(spark, sf_dir, strategy: str = "LOF") -> DataFrame:
    return staged(b.predictions(spark, sf_dir, strategy), "predictions")


def _optimal(rows: DataFrame) -> DataFrame:
    return evaluation.mcc_threshold(rows, ["device_id"], **MCC_GRID)


def mcc_threshold(spark, sf_dir):
    return stable(_optimal(_stored_predictions(spark, sf_dir)))


def mcc_threshold_global(spark, sf_dir):
    rows = _stored_predictions(spark, sf_dir, "AE global")
    return stable(evaluation.mcc_threshold(rows, [], **FLEET_GRID))


def mcc_threshold_ae(spark, sf_dir):
    """Per device over the autoencoders' grid."""
    return stable(evaluation.mcc_threshold(b.predictions(spark, sf_dir, "AE per device"), ["device_id"], **AE_GRID))


def threshold_comparison_fleet(spark, sf_dir):
    """The fleet's optimum, fitted once, judged device by device."""
    rows = b.predictions(spark, sf_dir, "AE global")
    best = evaluation.mcc_threshold(rows, [], **FLEET_GRID)
    optimal = with_scalars(rows.select("device_id").distinct(), best.select("threshold"))
    return evaluation.threshold_comparison(rows, b.thresholds(spark), optimal)


def threshold_comparison(spark, sf_dir):
    rows = _stored_predictions(spark, sf_dir)
    return evaluation.threshold_comparison(rows, b.thresholds(spark), _optimal(rows))


def score_histogram(spark, sf_dir):
    rows = _stored_predictions(spark, sf_dir)
    limits = evaluation.histogram_limits(rows, b.thresholds(spark), _optimal(rows))
    return evaluation.score_histogram(rows, limits)


def score_histogram_zoom(spark, sf_dir):
    rows = _stored_predictions(spark, sf_dir)
    limits = evaluation.histogram_limits(rows, b.thresholds(spark), _optimal(rows), zoom=True)
    return evaluation.score_histogram(rows, limits)


def roc_curve(spark, sf_dir):
    return evaluation.roc_curve(_strategies(spark, sf_dir), ["strategy"])


def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_strategies(spark, sf_dir), ["strategy"])


def _samples(spark, sf_dir) -> DataFrame:
    rows = _stored_strategies(spark, sf_dir)
    return comparison.sampled_strategies(rows, "row_key", PR_PREVALENCES)


def pr_curve(spark, sf_dir):
    return comparison.strategy_pr_curve(_samples(spark, sf_dir))


def average_precision(spark, sf_dir):
    return comparison.strategy_average_precision(_samples(spark, sf_dir))


def prevalence_sensitivity(spark, sf_dir):
    return evaluation.prevalence_sensitivity(_stored_predictions(spark, sf_dir), "row_key", b.PREVALENCES)


def recalibrated_prevalence(spark, sf_dir):
    rows = _stored_predictions(spark, sf_dir)
    return evaluation.recalibrated_prevalence(rows, "row_key", _optimal(rows), b.PREVALENCES)


def operational_metrics(spark, sf_dir):
    rows = _stored_strategies(spark, sf_dir)
    return comparison.operational_metrics(rows, "row_key", b.STRATEGIES, b.PREVALENCES)


def strategy_global(spark, sf_dir):
    return comparison.strategy_global(_strategies(spark, sf_dir), b.STRATEGIES)


def strategy_device_mcc(spark, sf_dir):
    return comparison.strategy_device_mcc(_strategies(spark, sf_dir), b.STRATEGIES)


def strategy_attack_recall(spark, sf_dir):
    return comparison.strategy_attack_recall(_strategies(spark, sf_dir), b.STRATEGIES)


# ---- run records ---------------------------------------------------------


def size_regression(spark, sf_dir):
    return stable(records.size_regression(b.records(spark, sf_dir).where("strategy = 'LOF'")))


def scalability_table(spark, sf_dir):
    return stable(records.scalability_table(b.records(spark, sf_dir)))


def training_curves(spark, sf_dir):
    return stable(records.training_curves(b.history(spark, sf_dir), ["click", "view", "error"]))


def best_epoch(spark, sf_dir):
    return stable(records.best_epoch(b.history(spark, sf_dir), ["device_id", "model_id"]))


def best_trial(spark, sf_dir):
    return stable(records.best_trial(b.trials(spark, sf_dir), ["device_id"], ["n_neighbors", "metric"]))


# ---- scaling -------------------------------------------------------------


def scaler_fit(spark, sf_dir):
    fitted = scaling.fit_scaler(_splits(spark, sf_dir).where("split = 'train'"), b.FEATURES)
    return stable(scaling.scaler_long(fitted, b.FEATURES))


def scaler_apply(spark, sf_dir):
    rows, _ = scaling.scale_splits(_splits(spark, sf_dir), b.FEATURES)
    return _rounded_features(rows.where("split = 'train'")).select("row_key", "device_id", *b.FEATURES)


def _rounded_features(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(F.col(c).cast("double"), 5).alias(c) if c in b.FEATURES else F.col(c) for c in rows.columns])


def unsigned_zero(c):
    """Zero without a sign."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def _scaled_moments(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[unsigned_zero(F.round(F.avg(F.col(f).cast("double")), 6)).alias(f"mean_{f}") for f in b.FEATURES],
        *[F.round(F.stddev_pop(F.col(f).cast("double")), 6).alias(f"std_{f}") for f in b.FEATURES],
    )


def scale_splits(spark, sf_dir):
    """Per-device scaling of all four splits, summarised."""
    rows, _ = scaling.scale_splits(_splits(spark, sf_dir), b.FEATURES)
    return _scaled_moments(rows, ["device_id", "split"])


def scale_splits_global(spark, sf_dir):
    """Fleet-wide scaling of all four splits, summarised."""
    rows, _ = scaling.scale_splits(_splits(spark, sf_dir), b.FEATURES, by=None)
    return _scaled_moments(rows, ["split"])


def fleet_report(spark, sf_dir):
    """Flagship: split, scale per device, score, threshold at benign p99, predict, evaluate."""
    splits = staged(_splits(spark, sf_dir), "splits", ["split"])
    rows, _ = scaling.scale_splits(splits, b.FEATURES)
    squares = sum((F.col(f).cast("double") * F.col(f).cast("double") for f in b.FEATURES[1:]), F.col(b.FEATURES[0]).cast("double") * F.col(b.FEATURES[0]).cast("double"))
    scored = rows.withColumn("score", F.round(squares / len(b.FEATURES), 5).cast("float")).drop(*b.FEATURES)
    scored = staged(scored, "scored", ["split"])
    criteria = th.threshold_criteria(scored.where("split = 'val'"), ["device_id"])
    limits = criteria.where("criterion = 'p99'").select("device_id", "threshold")
    tested = scored.where("split like 'test_%'").withColumn("y_true", F.col("is_attack").cast("byte"))
    return evaluation.device_metrics(th.apply_thresholds(tested, limits))


QUERIES = {
    f.__name__: f
    for f in (
        scan_csv, label_from_filename, ingest_by_device, ingest_wide, prepare_run, file_manifest, file_catalog, scan_projected,
        scores_with_metadata, split_counts, artifact_sizes, run_summary_scan, union_devices, history_scan,
        filter_benign, apply_threshold, threshold_lookup, repredict, score_group, parse_label, feature_grammar,
        strategy_union, split_benign, device_splits, global_splits, sample_exact, sample_stratified,
        prevalence_resample, prevalence_sample, bootstrap_threshold, bootstrap_cv, structural_summary, class_distribution,
        device_class_pivot, family_share, attack_type_totals, device_family_pivot, missing_profile,
        duplicate_summary, duplicate_summary_device, duplicate_summary_global,
        duplicate_pivot, feature_variance, constant_features, low_variance_profile, scale_profile, range_topk,
        iqr_topk, window_correlation, feature_correlation, score_summary, boxplot_stats, ks_train_val,
        ks_train_val_global, threshold_criteria, threshold_fpr, threshold_criteria_reconstruction,
        threshold_criteria_fleet, confusion_matrix, global_metrics, device_metrics, family_metrics, type_metrics,
        extreme_type_metrics, extreme_recall_pivot, mcc_threshold, mcc_threshold_global, threshold_comparison, mcc_threshold_ae, threshold_comparison_fleet,
        score_histogram, score_histogram_zoom, roc_curve, roc_auc, pr_curve, average_precision,
        prevalence_sensitivity, recalibrated_prevalence, operational_metrics, strategy_global, strategy_device_mcc,
        strategy_attack_recall, size_regression, scalability_table, training_curves, best_epoch, best_trial,
        scaler_fit, scaler_apply, scale_splits, scale_splits_global, fleet_report,
    )
} | {"dup_public": dup_public, "dup_device": dup_device, "dup_global": dup_global}
