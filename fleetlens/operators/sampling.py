"""Seeded splits and samples of exact size.

Random order is an md5 over the row key and a seed, so it is the same on any
cluster, in any partitioning and after any retry. Sizes are met exactly by
finding the hash at which a group's prefix ends (``ordering.prefix_cuts``);
rows are then labelled by one comparison and never sorted or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.expressions import hash_order, ratio
from fleetlens.operators.joins import lookup_join, with_scalars
from fleetlens.operators.ordering import prefix_cuts, ranked_values
from fleetlens.session import staged


def _wide_cuts(cuts: DataFrame, group: list[str], labels: list[str]) -> DataFrame:
    return cuts.groupBy(*group).agg(*[F.max(F.when(F.col("cut") == c, F.col("cutoff"))).alias(c) for c in labels])


def _inside(order: Column, cutoff: str) -> Column:
    """Rows up to a cutoff; an absent cutoff stands for an empty prefix."""
    return F.coalesce(order <= F.col(cutoff), F.lit(False))


def split_benign(
    df: DataFrame,
    key: str,
    *,
    train_size: float = 0.6,
    val_size: float = 0.2,
    seed: int = 42,
    group: str = "device_id",
) -> DataFrame:
    """Adds ``split``: train / val / test_benign by position, attacks to test_attack.

    Benign rows of each device are cut at floor(n * train) and
    floor(n * (train + val)) of the seeded order.
    """
    order = hash_order(seed, key)
    benign = df.where(~F.col("is_attack")).select(group, order.alias("order"))
    cuts = prefix_cuts(
        benign,
        [group],
        "order",
        {
            "train_end": lambda n: F.floor(n.cast("double") * F.lit(train_size)),
            "val_end": lambda n: F.floor(n.cast("double") * F.lit(train_size + val_size)),
        },
    )
    ends = _wide_cuts(cuts, [group], ["train_end", "val_end"])
    marked = lookup_join(df.withColumn("_order", order), ends, [group], "left")
    split = (
        F.when(F.col("is_attack"), "test_attack")
        .when(_inside(F.col("_order"), "train_end"), "train")
        .when(_inside(F.col("_order"), "val_end"), "val")
        .otherwise("test_benign")
    )
    return marked.withColumn("split", split).drop("_order", "train_end", "val_end")


def sample_exact(df: DataFrame, key: str, fraction: float, *, seed: int = 42, group: list[str] | None = None) -> DataFrame:
    """round(n * fraction) rows, of the table or of each group, without replacement.

    With a group its value is part of the seed, so groups draw independently.
    """
    group = group or []
    order = hash_order(seed, key, *group)
    size = {"take": lambda n: F.bround(n.cast("double") * F.lit(fraction))}
    cuts = prefix_cuts(df.select(*group, order.alias("order")), group, "order", size)
    if not group:
        end = cuts.first()
        return df.where(order <= F.lit(end["cutoff"] if end else ""))
    marked = lookup_join(df, _wide_cuts(cuts, group, ["take"]), group, "left")
    return marked.where(_inside(order, "take")).drop("take")


def attack_need(prevalence: float, n_benign: int, *, rounding: str = "floor") -> int:
    """Attack rows that give the prevalence next to ``n_benign`` benign rows."""
    exact = prevalence / (1 - prevalence) * n_benign
    return round(exact) if rounding == "round" else int(exact)


def _needs(predictions: DataFrame, by: list[str], prevalences: list[float], rounding: str) -> DataFrame:
    """(by, n_benign, fp, n_attack, wanted): counts per group, and the attack rows of each prevalence as (cut, need).

    Too small an attack pool is an error.
    """
    counts = predictions.groupBy(*by).agg(
        F.count_if(F.col("y_true") == 0).alias("n_benign"),
        F.count_if((F.col("y_true") == 0) & (F.col("y_pred") == 1)).alias("fp"),
        F.count_if(F.col("y_true") == 1).alias("n_attack"),
    )
    sizes = []
    for p in prevalences:
        exact = F.lit(p / (1 - p)) * F.col("n_benign").cast("double")
        need = F.rint(exact) if rounding == "round" else F.floor(exact)
        sizes.append(F.struct(F.lit(str(p)).alias("cut"), need.cast("long").alias("need")))
    table = staged(counts.withColumn("wanted", F.array(*sizes)), "needs")
    short = table.select("*", F.inline("wanted")).where(F.col("need") > F.col("n_attack")).limit(1).collect()
    if short:
        group = tuple(short[0][c] for c in by)
        raise ValueError(
            f"not enough attack rows for prevalence {short[0]['cut']} {group}: {short[0]['need']} needed, {short[0]['n_attack']} available"
        )
    return table


def _orders(rows: DataFrame, key: str, columns: list[str], repeats: int, seed: int) -> DataFrame:
    """(columns, _bound, repeat, order): the place of every row in the seeded order of every repeat.

    Repeats become rows before they are hashed: an expression over rows is compiled, a lambda over an array is not.
    """
    each = rows.select(*columns, "_bound", key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    return each.select(*columns, "_bound", "repeat", hash_order(F.col("repeat") + seed, key).alias("order"))


def _draws(predictions: DataFrame, key: str, by: list[str], needs: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(by, repeat, cut, cutoff, tp): where each draw ends in its seeded order."""
    largest = F.array_max(F.transform("wanted", lambda w: w["need"]))
    # A draw is a short prefix of its order, so the rows beyond a generous hash
    # bound are left out; should the bound ever be too tight, all rows are used.
    share = F.least((largest * 1.25 + 64) / F.greatest("n_attack", F.lit(1)), F.lit(1.0))
    bound = F.lpad(F.lower(F.hex(F.floor(share * float(2**32)).cast("long"))), 9, "0")
    bounds = needs.select(*by, bound.alias("_bound"))
    attacks = predictions.where("y_true = 1").select(*by, key, "y_pred")
    ordered = lookup_join(attacks, bounds, by) if by else with_scalars(attacks, bounds)
    every = _orders(ordered, key, [*by, "y_pred"], repeats, seed)
    # Most repeats leave a row out.
    near = staged(every.where(F.concat(F.lit("0"), "order") < F.col("_bound")).drop("_bound"), "draws")
    cuts, group = needs.select(*by, "wanted"), [*by, "repeat"]
    drawn = staged(prefix_cuts(near, group, "order", cuts, {"tp": F.col("y_pred")}), "drawn")
    wanted = needs.agg(F.sum(F.size(F.filter("wanted", lambda w: w["need"] > 0)))).first()[0] or 0
    if drawn.count() < wanted * repeats:
        drawn = staged(prefix_cuts(every.drop("_bound"), group, "order", cuts, {"tp": F.col("y_pred")}), "drawn")
    return drawn


def prevalence_counts(
    predictions: DataFrame,
    key: str,
    prevalences: list[float],
    *,
    by: list[str] | None = None,
    repeats: int = 1,
    seed: int = 42,
    rounding: str = "floor",
) -> DataFrame:
    """Confusion counts of prevalence resamples: all benign rows plus drawn attacks.

    Benign counts never change and are taken once. Repeat r draws attacks in
    the order md5(key, seed + r); its samples for the several prevalences are
    prefixes of that one order. Only counts leave the job; no sample is built.
    Too small an attack pool is an error.
    """
    by = by or []
    needs = _needs(predictions, by, prevalences, rounding)
    drawn = _draws(predictions, key, by, needs, repeats, seed)
    # Empty draws have no cut: the grid of (group, prevalence, repeat) keeps them.
    grid = needs.select(*by, "fp", "n_benign", F.inline("wanted")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    tp = F.coalesce("tp", F.lit(0))
    return grid.join(drawn.select(*by, "repeat", "cut", "tp"), [*by, "repeat", "cut"], "left").select(
        *by,
        F.col("cut").cast("double").alias("prevalence"),
        "repeat",
        F.col("need").alias("n_attack"),
        tp.alias("tp"),
        "fp",
        (F.col("n_benign") - F.col("fp")).alias("tn"),
        (F.col("need") - tp).alias("fn"),
    )


def prevalence_samples(
    predictions: DataFrame,
    key: str,
    prevalences: list[float],
    *,
    by: list[str] | None = None,
    seed: int = 42,
    rounding: str = "round",
) -> DataFrame:
    """Per group and prevalence: all benign rows and exactly the attacks asked for.

    Adds ``prevalence``. Rows are picked by one comparison with the end of
    each draw; nothing is sorted.
    """
    by = by or []
    needs = _needs(predictions, by, prevalences, rounding)
    drawn = _draws(predictions, key, by, needs, 1, seed)
    ends = drawn.groupBy(*by).agg(*[F.max(F.when(F.col("cut") == str(p), F.col("cutoff"))).alias(f"_end{i}") for i, p in enumerate(prevalences)])
    # Benign rows are in every sample: only attacks need their place.
    marked = predictions.withColumn("_order", F.when(F.col("y_true") == 0, F.lit(None)).otherwise(hash_order(seed, key)))
    marked = lookup_join(marked, ends, by, "left") if by else with_scalars(marked, ends)
    limits = [F.struct(F.lit(p).alias("prevalence"), F.coalesce(f"_end{i}", F.lit("")).alias("cutoff")) for i, p in enumerate(prevalences)]
    each = marked.select(*predictions.columns, "_order", F.inline(F.array(*limits)))
    return each.where((F.col("y_true") == 0) | (F.col("_order") <= F.col("cutoff"))).drop("_order", "cutoff")


def prevalence_sample(
    predictions: DataFrame, key: str, prevalence: float, *, seed: int = 42, rounding: str = "round"
) -> DataFrame:
    """A single prevalence sample of the whole table."""
    return prevalence_samples(predictions, key, [prevalence], seed=seed, rounding=rounding).drop("prevalence")


UNIFORM_DIGITS = 10  # hex digits, 40 bits


def _uniform(digest: Column, nth: int = 0) -> Column:
    """The nth open-interval uniform cut from an md5 text (three fit)."""
    digits = F.substring(digest, 1 + nth * UNIFORM_DIGITS, UNIFORM_DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(16**UNIFORM_DIGITS))


GAMMA_TRIES = 8


def _gamma(shape: Column, seed: Column) -> Column:
    """Gamma(shape, 1) draw for shape >= 1 (Marsaglia and Tsang 2000).

    A proposal fails in under 5 % of cases; eight failures in a row raise.
    """
    d = shape - F.lit(1.0) / 3.0
    c = F.lit(1.0) / F.sqrt(d * 9.0)
    tries = F.sequence(F.lit(1), F.lit(GAMMA_TRIES))
    digests = F.transform(tries, lambda i: F.md5(F.concat_ws("|", seed, i.cast("string"))))
    normals = F.transform(
        digests,
        lambda m: F.struct(
            (F.sqrt(F.log(_uniform(m)) * -2.0) * F.cos(_uniform(m, 1) * (2.0 * 3.141592653589793))).alias("x"),
            F.log(_uniform(m, 2)).alias("lnu"),
        ),
    )
    rooted = F.transform(normals, lambda s: F.struct(s["x"].alias("x"), s["lnu"].alias("lnu"), (s["x"] * c + 1.0).alias("r")))
    cubed = F.transform(
        F.filter(rooted, lambda s: s["r"] > 0),
        lambda s: F.struct(s["x"].alias("x"), s["lnu"].alias("lnu"), (s["r"] * s["r"] * s["r"]).alias("v")),
    )
    accepted = F.filter(
        cubed, lambda s: s["lnu"] < s["x"] * s["x"] * 0.5 + d - d * s["v"] + d * F.log(s["v"])
    )
    return F.coalesce(
        d * F.get(accepted, F.lit(0))["v"],
        F.raise_error(F.lit("no gamma proposal was accepted")).cast("double"),
    )


def bootstrap_quantiles(
    scores: DataFrame, group: list[str], value: str, probs: list[float], *, repeats: int = 2000, seed: int = 42
) -> DataFrame:
    """(group, prob, repeat, quantile): quantiles of resamples of size n with replacement.

    A resample picks ranks independently and uniformly, so its j-th smallest
    value is the original value of rank ceil(n * U(j)), U(j) being the j-th of
    n uniform order statistics, which is Beta(j, n - j + 1). Two such draws per
    repeat replace n picks: the cost does not grow with the group.
    """
    n = F.col("total").cast("double")
    sizes = scores.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("total"))
    low = F.floor((n - 1.0) * F.col("prob")) + 1
    tag = [*[F.col(g).cast("string") for g in group], F.col("prob_id").cast("string"), F.col("repeat").cast("string"), F.lit(str(seed))]
    named = lambda part: F.concat_ws("|", *tag, F.lit(part))
    draws = (
        sizes.withColumn("probs", F.array(*[F.struct(F.lit(i).alias("prob_id"), F.lit(float(p)).alias("prob")) for i, p in enumerate(probs)]))
        .select(*group, "total", F.inline("probs"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
        .repartition(scores.sparkSession.sparkContext.defaultParallelism, *group, "repeat")
        .withColumn("low", low.cast("long"))
        .withColumn("g1", _gamma(F.col("low").cast("double"), named("x")))
        .withColumn("g2", _gamma(n - F.col("low").cast("double") + 1.0, named("y")))
        .withColumn("u_low", F.col("g1") / (F.col("g1") + F.col("g2")))
        # The next order statistic is the least of the n - j uniforms left above u_low.
        .withColumn(
            "u_high",
            F.when(
                F.col("low") < F.col("total"),
                F.lit(1.0)
                - (F.lit(1.0) - F.col("u_low"))
                * F.pow(_uniform(F.md5(named("z"))), F.lit(1.0) / (n - F.col("low").cast("double"))),
            ).otherwise(F.col("u_low")),
        )
        .withColumn("part", (n - 1.0) * F.col("prob") - (F.col("low").cast("double") - 1.0))
        .select(
            *group,
            "prob",
            "repeat",
            "part",
            F.greatest(F.lit(1), F.ceil(F.col("u_low") * n)).cast("long").alias("rank_low"),
            F.greatest(F.lit(1), F.ceil(F.col("u_high") * n)).cast("long").alias("rank_high"),
        )
    )
    draws = staged(draws, "bootstrap-draws")
    wanted = draws.select(*group, F.explode(F.array("rank_low", "rank_high")).alias("rank")).distinct()
    values = ranked_values(scores, group, value, wanted=wanted)
    low_v = values.select(*group, F.col("rank").alias("rank_low"), F.col("v").alias("v_low"))
    high_v = values.select(*group, F.col("rank").alias("rank_high"), F.col("v").alias("v_high"))
    return (
        draws.join(low_v, [*group, "rank_low"])
        .join(high_v, [*group, "rank_high"])
        .select(
            *group,
            "prob",
            "repeat",
            (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("part")).alias("quantile"),
        )
    )


def bootstrap_stability(
    scores: DataFrame, group: list[str], value: str, criteria: dict[str, float], *, repeats: int = 2000, seed: int = 42
) -> DataFrame:
    """Mean, spread and 95 % interval of bootstrapped quantile thresholds."""
    names = F.create_map(*[x for name, p in criteria.items() for x in (F.lit(float(p)), F.lit(name))])
    draws = bootstrap_quantiles(scores, group, value, list(criteria.values()), repeats=repeats, seed=seed)
    # At most ``repeats`` rows per (group, criterion), so the exact percentile is bounded.
    return (
        draws.groupBy(*group, names[F.col("prob")].alias("criterion"))
        .agg(
            F.avg("quantile").alias("mean_threshold"),
            F.stddev_samp("quantile").alias("std_threshold"),
            F.percentile("quantile", F.lit(0.025)).alias("ci_2_5"),
            F.percentile("quantile", F.lit(0.975)).alias("ci_97_5"),
        )
        .withColumn("cv_threshold", ratio(F.col("std_threshold"), F.col("mean_threshold")))
    )
