import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.expressions import hash_order, value_bucket, value_key
from fleetlens.operators import ordering
from fleetlens.operators.evaluation import _counts_above


@pytest.fixture(scope="module")
def scores(spark):
    """Two groups, one holding most rows, with ties, zeros and negative values."""
    rng = np.random.default_rng(7)
    big = np.round(rng.normal(0, 2, 3000), 1).tolist() + [0.0] * 500
    small = rng.exponential(1, 41).tolist()
    rows = [("a", float(v)) for v in big] + [("b", float(v)) for v in small]
    return spark.createDataFrame(rows, "g string, v double").repartition(5), {"a": np.array(big), "b": np.array(small)}


def test_value_bucket_is_monotone(spark):
    values = sorted([-1e300, -5.0, -1e-300, 0.0, 5e-324, 1e-9, 0.999999, 1.0, 1.0000001, 7.5, 1e300])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bucket("v").alias("b")).orderBy("v")
    buckets = [r["b"] for r in rows.collect()]
    assert buckets == sorted(buckets)


def test_value_key_is_monotone_and_fine(spark):
    rng = np.random.default_rng(3)
    powers = [float(2.0**k) for k in (-1074, -1022, -300, -1, 0, 1, 52, 1023)]
    near = [np.nextafter(p, way) for p in powers for way in (0.0, np.inf) if p > 1e-320 or way]
    values = sorted({*powers, *map(float, near), *rng.normal(0, 1, 300).tolist(), *(1 + rng.random(300) / 1000).tolist(), 0.0, -1.0, float("inf"), float("-inf")})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_key("v").alias("k")).orderBy("v").collect()
    keys = [r["k"] for r in rows]
    assert keys == sorted(keys) and all(b - a >= 0 for a, b in zip(keys, keys[1:], strict=False))
    assert max(keys.count(k) for k in set(keys)) <= 3


def test_a_full_bucket_is_cut_finer_before_it_is_ordered(spark, monkeypatch):
    """Many distinct doubles within one bucket: no window gets more than a bounded part of them."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 500)
    values = np.concatenate([1 + np.random.default_rng(2).random(200_000) / 1000, -3 - np.random.default_rng(3).random(50_000) / 1000])
    df = spark.createDataFrame(list(zip(["a"] * 150_000 + ["b"] * 100_000, values.tolist(), strict=True)), "g string, v double").repartition(8)
    seen = []
    keep = ordering._finer
    monkeypatch.setattr(ordering, "_finer", lambda *a: seen.append(keep(*a)) or seen[-1])
    probs = {"q1": 0.25, "mid": 0.5, "p999": 0.999}
    for r in ordering.quantiles(df, ["g"], "v", probs).collect():
        own = values[:150_000] if r["g"] == "a" else values[150_000:]
        assert [r[p] for p in probs] == [pytest.approx(np.quantile(own, p), abs=1e-13) for p in probs.values()]
    assert seen and seen[-1][3] <= 500


def test_curves_read_their_source_once(spark, tmp_path):
    from fleetlens.operators import evaluation

    rows = [(f"s{i % 3}", float(i % 97), int(i * 7 % 5 == 0)) for i in range(2000)]
    spark.createDataFrame(rows, "strategy string, score double, y_true int").write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    for curve in (evaluation.roc_curve, evaluation.roc_auc, evaluation.pr_curve, evaluation.average_precision):
        df = curve(table, ["strategy"])
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("FileScan parquet") == 1, curve.__name__


def test_draws_are_dropped_inside_the_array(spark, monkeypatch):
    from fleetlens.operators import sampling

    rows = [(f"k{i}", int(i >= 6000), i % 2) for i in range(60_000)]
    table = spark.createDataFrame(rows, "key string, y_true int, y_pred int").repartition(4)
    kept = {}
    keep = sampling.staged
    monkeypatch.setattr(sampling, "staged", lambda df, label, *a: kept.setdefault(label, keep(df, label, *a)))
    counts = sampling.prevalence_counts(table, "key", [0.1, 0.05], repeats=12).collect()
    drawn = 12 * max(r["n_attack"] for r in counts)
    assert len(counts) == 24 and kept["draws"].count() < 2 * drawn


def test_quantiles_match_numpy(scores):
    df, expected = scores
    probs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "p999": 0.999, "hi": 1.0}
    for r in ordering.quantiles(df, ["g"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(expected[r["g"]], p), abs=1e-12)


def test_quantiles_without_group_and_any_partitioning(scores):
    df, expected = scores
    everything = np.concatenate(list(expected.values()))
    for parts in (1, 13):
        got = ordering.quantiles(df.repartition(parts), [], "v", {"p": 0.9}).first()["p"]
        assert got == pytest.approx(np.quantile(everything, 0.9))


def test_lookup_beyond_the_size_bound_gives_the_same(scores, monkeypatch):
    from fleetlens.operators import joins

    df, expected = scores
    real = joins.bounded_local
    # Every checked side counts as too large; the hot-key list keeps its own bound.
    monkeypatch.setattr(joins, "bounded_local", lambda d, limit=joins.LOOKUP_ROWS: None if limit == joins.LOOKUP_ROWS else real(d, limit))
    got = {r["g"]: r["p"] for r in ordering.quantiles(df, ["g"], "v", {"p": 0.75}).collect()}
    assert got == pytest.approx({g: np.quantile(v, 0.75) for g, v in expected.items()})


def test_quantile_grid_matches_numpy(scores):
    df, expected = scores
    probs = np.linspace(0, 0.3, 50)
    rows = ordering.quantile_grid(df, ["g"], "v", probs.tolist()).orderBy("g", "idx").collect()
    for g, values in expected.items():
        assert [r["quantile"] for r in rows if r["g"] == g] == pytest.approx(np.quantile(values, probs).tolist())


def test_prefix_cuts_take_exact_prefixes(spark):
    keys = [(g, f"{g}{i}", i % 3) for g, n in (("a", 1000), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(keys, "g string, k string, m int").withColumn("o", hash_order(42, "k"))
    cuts = ordering.prefix_cuts(
        df, ["g"], "o", {"half": lambda n: F.floor(n * F.lit(0.5)), "all": lambda n: n}, {"m": F.col("m")}
    ).collect()
    rows = {g: sorted((r["o"], r["m"]) for r in df.collect() if r["g"] == g) for g in "abc"}
    seen = {(r["g"], r["cut"]): r for r in cuts}
    assert ("c", "half") not in seen
    for (g, cut), r in seen.items():
        n = len(rows[g]) // 2 if cut == "half" else len(rows[g])
        assert r["need"] == n and r["cutoff"] == rows[g][n - 1][0]
        assert r["m"] == sum(m for _, m in rows[g][:n])


@pytest.mark.parametrize("descending", [False, True])
def test_cumulative_counts(scores, descending):
    df, expected = scores
    out = ordering.cumulative(df, ["g"], "v", {"n": F.lit(1)}, descending=descending, lead=True)
    rows = sorted(out.where("g = 'a'").collect(), key=lambda r: r["v"], reverse=descending)
    values = expected["a"]
    for r, following in zip(rows, rows[1:] + [None]):
        assert r["cum_n"] == ((values >= r["v"]).sum() if descending else (values <= r["v"]).sum())
        assert r["next_n"] == (following["n"] if following else None)


def test_counts_above_points(spark):
    rows = spark.createDataFrame([(1, s, y) for s, y in ((1.0, 0), (1.0, 1), (2.0, 1), (2.0, 1))], "d int, score double, y_true int")
    points = spark.createDataFrame([(1, t) for t in (0.5, 1.0, 1.5, 2.0)], "d int, threshold double")
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in _counts_above(rows, points, ["d"]).collect()}
    assert got == {0.5: (3, 1, 0, 0), 1.0: (2, 0, 1, 1), 1.5: (2, 0, 1, 1), 2.0: (0, 0, 1, 3)}


def test_finer_buckets_leave_the_source(spark, tmp_path, monkeypatch):
    """Rows of full buckets are written once; later steps do not read the source again."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 4)
    spark.range(3000).select((F.col("id") % 7 + 100 + F.col("id") / 1e6).alias("x")).write.parquet(str(tmp_path / "source"))
    table = spark.read.parquet(str(tmp_path / "source"))
    found = ordering.quantiles(table, [], "x", {"q": 0.5})
    assert not [f for f in found.inputFiles() if "source" in f]
    assert found.first()["q"] == table.agg(F.percentile("x", F.lit(0.5))).first()[0]
