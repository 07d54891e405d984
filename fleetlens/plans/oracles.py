"""Independent SQL for the named queries, over the same base tables."""

from __future__ import annotations

from fleetlens.plans import bindings as b
from fleetlens.plans.tables import AE_GRID, DUP_FEATURES, EXTREME_DEVICES, FLEET_GRID, MCC_GRID, PR_PREVALENCES
from fleetlens.operators.evaluation import linspace
from fleetlens.operators.sampling import GAMMA_TRIES, UNIFORM_DIGITS


def st(expr: str, name: str | None = None) -> str:
    """Nine significant digits, half up."""
    digits = "8 - floor(log10(abs(x)))"
    up, down = f"pow(10.0::DOUBLE, greatest({digits}, 0))", f"pow(10.0::DOUBLE, greatest(-({digits}), 0))"
    near = f"floor(abs(x) * {up} / {down} + 0.5) * {down} / {up} * sign(x)"
    lam = f"lambda x: CASE WHEN x <> 0 AND isfinite(x) THEN {near} ELSE x END"
    return f"list_transform([cast({expr} as double)], {lam})[1] AS {name or expr}"


def case_map(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


CURRENT = "VALUES " + ", ".join(f"({d}, {t}::DOUBLE)" for d, t in b.CURRENT_THRESHOLDS.items())

ROWS = """
rows_ AS (
  SELECT *, CAST(l_suppkey % 9 + 1 AS INTEGER) AS device_id,
    concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT),
              strftime(l_shipdate, '%Y-%m-%d')) AS row_key,
    l_returnflag <> 'N' AS is_attack,
    CASE WHEN l_returnflag = 'N' THEN 'benign' WHEN l_returnflag = 'A' OR l_suppkey % 9 + 1 IN (3, 7) THEN 'gafgyt' ELSE 'mirai' END AS attack_family,
    CASE WHEN l_returnflag = 'N' THEN 'benign' WHEN l_linestatus = 'F' THEN 'tcp'
         WHEN l_linenumber % 2 = 0 THEN 'udp' ELSE 'scan' END AS attack_type
  FROM lineitem)"""

TRAFFIC = (
    ROWS
    + """,
traffic AS (SELECT row_key, device_id, CAST(l_quantity AS FLOAT) AS quantity, CAST(l_extendedprice AS FLOAT) AS extendedprice,
    CAST(l_discount AS FLOAT) AS discount, CAST(l_tax AS FLOAT) AS tax, is_attack, attack_family, attack_type,
    CASE WHEN is_attack THEN concat_ws('.', device_id, attack_family, attack_type, 'csv')
         ELSE concat_ws('.', device_id, 'benign', 'csv') END AS file_name
  FROM rows_)"""
)

CATALOG = (
    TRAFFIC
    + """,
catalog AS (SELECT file_name, t.device_id AS device, s.s_name AS device_name, is_attack, attack_family AS diagnostic, attack_type,
    count(*) AS n_samples, 4 AS n_features
  FROM traffic t LEFT JOIN supplier s ON s.s_suppkey = t.device_id GROUP BY ALL)"""
)

BOOST = "(CASE l_returnflag WHEN 'A' THEN l_tax * 20.0::DOUBLE WHEN 'R' THEN l_discount * 30.0::DOUBLE ELSE 0.0::DOUBLE END)"
SCORES = {
    "LOF": f"l_extendedprice / 30000.0::DOUBLE + {BOOST}",
    "AE per device": f"l_quantity / 15.0::DOUBLE + {BOOST} * 1.5::DOUBLE",
    "AE global": f"(l_extendedprice / 30000.0::DOUBLE + l_quantity / 15.0::DOUBLE) * 0.5::DOUBLE + {BOOST} * 0.5::DOUBLE",
}


def predictions(strategy: str = "LOF", name: str = "pred") -> str:
    limit = case_map("device_id", b.CURRENT_THRESHOLDS)
    return (
        ROWS
        + f""",
{name} AS (SELECT row_key, device_id, score, CAST(is_attack AS TINYINT) AS y_true,
    CAST(score > CAST({limit} AS FLOAT) AS TINYINT) AS y_pred, attack_family, attack_type, is_attack
  FROM (SELECT *, CAST({SCORES[strategy]} AS FLOAT) AS score FROM rows_))"""
    )


def strategies() -> str:
    limit = case_map("device_id", b.CURRENT_THRESHOLDS)
    union = " UNION ALL ".join(
        f"SELECT '{s}' AS strategy, *, CAST({SCORES[s]} AS FLOAT) AS score FROM rows_" for s in b.STRATEGIES
    )
    return (
        ROWS
        + f""",
strat AS (SELECT strategy, row_key, device_id, score, CAST(is_attack AS TINYINT) AS y_true,
    CAST(score > CAST({limit} AS FLOAT) AS TINYINT) AS y_pred, attack_family, attack_type FROM ({union}))"""
    )


def splits(source: str, name: str = "splits", salt: str = "42") -> str:
    return f"""
{name} AS (SELECT s.* EXCLUDE (rn, n), CASE WHEN is_attack THEN 'test_attack' WHEN rn <= floor(n * 0.6::DOUBLE) THEN 'train'
    WHEN rn <= floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test_benign' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY device_id, is_attack ORDER BY md5(row_key || '|{salt}')) AS rn,
      count(*) OVER (PARTITION BY device_id, is_attack) AS n FROM {source}) s)"""


def cells(true: str = "y_true", pred: str = "y_pred") -> str:
    return (
        f"count(*) FILTER ({true} = 1 AND {pred} = 1) AS tp, count(*) FILTER ({true} = 0 AND {pred} = 1) AS fp, "
        f"count(*) FILTER ({true} = 0 AND {pred} = 0) AS tn, count(*) FILTER ({true} = 1 AND {pred} = 0) AS fn"
    )


def ratio(a: str, c: str) -> str:
    return f"(CASE WHEN ({c}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({c})::DOUBLE END)"


def mcc(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    tp, fp, tn, fn = (f"({c})::DOUBLE" for c in (tp, fp, tn, fn))
    return ratio(f"{tp}*{tn} - {fp}*{fn}", f"sqrt(({tp}+{fp})*({tp}+{fn})) * sqrt(({tn}+{fp})*({tn}+{fn}))")


def nine(p: str = "") -> dict[str, str]:
    tp, fp, tn, fn = (p + c for c in ("tp", "fp", "tn", "fn"))
    recall, spec = ratio(tp, f"{tp}+{fn}"), ratio(tn, f"{tn}+{fp}")
    return {
        "recall": recall,
        "fpr": ratio(fp, f"{fp}+{tn}"),
        "balanced_accuracy": f"(CASE WHEN {tp}+{fn}=0 THEN {spec} WHEN {tn}+{fp}=0 THEN {recall} ELSE ({recall}+{spec})/2 END)",
        "mcc": mcc(tp, fp, tn, fn),
        "precision": ratio(tp, f"{tp}+{fp}"),
        "f1": ratio(f"2*{tp}", f"2*{tp}+{fp}+{fn}"),
        "accuracy": ratio(f"{tp}+{tn}", f"{tp}+{fp}+{tn}+{fn}"),
        "specificity": spec,
        "fnr": ratio(fn, f"{fn}+{tp}"),
    }


def metrics(names=None, p: str = "") -> str:
    found = nine(p)
    return ", ".join(f"round({found[n]}, 9) AS {p}{n}" for n in names or found)


def detection(by: str) -> str:
    return f"""SELECT {by}, n_samples, true_positives, n_samples - true_positives AS false_negatives,
      round({ratio('true_positives', 'n_samples')}, 9) AS recall, round({ratio('n_samples - true_positives', 'n_samples')}, 9) AS fnr
    FROM (SELECT {by}, count(*) AS n_samples, CAST(sum(y_pred) AS BIGINT) AS true_positives FROM pred WHERE y_true = 1 GROUP BY ALL)"""


def windowed() -> str:
    pairs = [("l_quantity", "l_linenumber", 6.0), ("l_extendedprice", "l_quantity", 1500.0), ("l_discount", "l_tax", 1.5)]
    cols = []
    for base, (x, y, unit) in zip(b.WINDOW_BASES, pairs):
        stem, stat = base.rsplit("_", 1)
        for w, share in b.WINDOW_WEIGHTS.items():
            cols.append(
                f"{x}::DOUBLE * {share}::DOUBLE + {y}::DOUBLE * {unit}::DOUBLE * {round(1 - share, 1)}::DOUBLE AS {stem}_{w}_{stat}"
            )
    return ROWS + f", win AS (SELECT row_key, device_id, {', '.join(cols)}, attack_family FROM rows_)"


def long_win() -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM win" for f in b.WINDOW_FEATURES)
    return windowed() + f", long_ AS ({parts})"


def _parts(feature: str) -> tuple[str, str]:
    """(base, window) of a binding feature name."""
    for w in sorted(b.WINDOW_WEIGHTS, key=len, reverse=True):
        if f"_{w}_" in feature:
            return feature.replace(f"_{w}_", "_"), w.replace("L0_", "L0.")
    raise ValueError(feature)


FEATURE_DIM = "VALUES " + ", ".join(
    "({}, '{}', '{}', '{}')".format(i, f, *_parts(f)) for i, f in enumerate(b.WINDOW_FEATURES)
)


def corr_pairs() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{x}' AS a, '{y}' AS b, abs(corr({x}, {y})) AS abs_r FROM win"
        for i, x in enumerate(b.WINDOW_FEATURES)
        for y in b.WINDOW_FEATURES
        if _parts(x)[0] == _parts(y)[0] or _parts(x)[1] == _parts(y)[1]
    )
    return windowed() + f", pairs AS ({parts}), dim(pos, feature, base, win) AS ({FEATURE_DIM})"


def ends(table: str, by: str, columns: str, n: int = 5) -> str:
    return (
        f"SELECT {columns}, 'smallest' AS \"end\" FROM (SELECT * FROM {table} ORDER BY {by}, feature LIMIT {n}) "
        f"UNION ALL SELECT {columns}, 'largest' AS \"end\" FROM (SELECT * FROM {table} ORDER BY {by} DESC, feature DESC LIMIT {n})"
    )


def quant(prob: float, column: str = "score") -> str:
    return f"quantile_cont({column}::DOUBLE, {prob})"


ALERTS = """alerts AS (SELECT event_id, CAST(user_id % 9 + 1 AS INTEGER) AS device_id, CAST(value AS FLOAT) AS score,
  CAST(event_type = 'error' AS TINYINT) AS y_true, event_type AS attack_type FROM events)"""

HISTORY = """history AS (SELECT CAST(user_id % 9 + 1 AS INTEGER) AS device_id, event_type AS model_id,
  CAST(event_id % 12 + 1 AS INTEGER) AS epoch, round(avg(value), 6) AS loss, round(max(value) / 10.0, 6) AS val_loss
  FROM events GROUP BY ALL)"""

SPLIT_SCORES = {s: predictions(s) + "," + splits("pred") for s in b.STRATEGIES}


def ks_sql(strategy: str, by: bool) -> str:
    part = "PARTITION BY device_id" if by else ""
    key, using, group = ("device_id, ", " USING (device_id)", "GROUP BY device_id") if by else ("", " ON true", "")
    join = (lambda t: f"JOIN {t} USING (device_id)") if by else (lambda t: f"CROSS JOIN {t}")
    return f"""WITH {SPLIT_SCORES[strategy]},
    s AS (SELECT {key} score, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS v
          FROM splits WHERE split IN ('train', 'val') GROUP BY ALL),
    c AS (SELECT {key} sum(a) OVER ({part} ORDER BY score)::DOUBLE / sum(a) OVER ({part}) AS fa,
          sum(v) OVER ({part} ORDER BY score)::DOUBLE / sum(v) OVER ({part}) AS fv FROM s),
    k AS (SELECT {key} max(abs(fa - fv)) AS ks FROM c {group}),
    m AS (SELECT {key} {', '.join(f"{fn} FILTER (split = '{sp}') AS {sp}_{nm}" for nm, fn in (('mean', 'avg(score::DOUBLE)'), ('std', 'stddev_pop(score::DOUBLE)'), ('max', 'max(score::DOUBLE)'), ('median', 'quantile_cont(score::DOUBLE, 0.5)')) for sp in ('train', 'val'))}
          FROM splits {group})
    SELECT {key} {st('ks', 'ks_statistic')}, {', '.join(st(f'{sp}_{nm}') for nm in ('mean', 'std', 'max', 'median') for sp in ('train', 'val'))}
    FROM k {join('m')}"""


def criteria(strategy: str, kind: str) -> str:
    """CTEs val and crit(device_id, criterion, threshold)."""
    extra = {
        "density": {
            "iqr_1_5": f"{quant(.75)} + 1.5 * ({quant(.75)} - {quant(.25)})",
            "iqr_3": f"{quant(.75)} + 3.0 * ({quant(.75)} - {quant(.25)})",
        },
        "reconstruction": {"mean_3std": "avg(score::DOUBLE) + 3 * stddev_pop(score::DOUBLE)"},
        "fleet": {"mean_3std": "avg(score::DOUBLE) + 3 * stddev_samp(score::DOUBLE)"},
    }[kind]
    rows = {"p99": quant(0.99), "p99_5": quant(0.995), "p99_9": quant(0.999), **extra}
    device = "0 AS device_id" if kind == "fleet" else "device_id"
    union = " UNION ALL ".join(f"SELECT device_id, '{k}' AS criterion, {v} AS threshold FROM val GROUP BY device_id" for k, v in rows.items())
    return SPLIT_SCORES[strategy] + f", val AS (SELECT {device}, score FROM splits WHERE split = 'val'), crit AS ({union})"


FPR_SQL = "SELECT c.device_id, criterion, threshold, avg((score::DOUBLE > threshold)::INT) AS fpr FROM val v JOIN crit c ON c.device_id = v.device_id GROUP BY ALL"


def optimal(n_candidates: int, min_quantile: float, max_quantile: float, source: str = "pred", name: str = "opt") -> str:
    """CTE opt(device_id, threshold, mcc) over a table with device_id."""
    grid = "[" + ", ".join(repr(q) for q in linspace(min_quantile, max_quantile, n_candidates)) + "]"
    return f"""
    cand AS (SELECT DISTINCT device_id, unnest(q) AS threshold FROM (
        SELECT device_id, quantile_cont(score::DOUBLE, {grid}) AS q FROM {source} GROUP BY device_id)),
    cell AS (SELECT device_id, score::DOUBLE AS score, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM {source} GROUP BY ALL),
    cum AS (SELECT device_id, score, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS ap, sum(neg) OVER g AS an
        FROM cell WINDOW w AS (PARTITION BY device_id ORDER BY score), g AS (PARTITION BY device_id)),
    counted AS (SELECT c.device_id, c.threshold, ap - cp AS tp, an - cn AS fp, cn AS tn, cp AS fn
        FROM cand c ASOF JOIN cum ON cum.device_id = c.device_id AND cum.score <= c.threshold),
    {name} AS (SELECT device_id, threshold, mcc FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY round(mcc, 12) DESC, threshold) AS rn
        FROM (SELECT *, {mcc()} AS mcc FROM counted)) WHERE rn = 1)"""


def histogram(zoom: bool) -> str:
    hi = "2.0 * greatest(c, o)" if zoom else "greatest(q, c, o)"
    return f"""WITH {predictions()}, {optimal(**MCC_GRID)}, cur(device_id, c) AS ({CURRENT}),
    lim AS (SELECT device_id, {hi} AS hi FROM (SELECT device_id, {quant(.995)} AS q FROM pred GROUP BY 1)
        JOIN cur USING (device_id) JOIN (SELECT device_id, threshold AS o FROM opt) USING (device_id)),
    edged AS (SELECT device_id, hi / 79.0 AS step, unnest(range(0, 79)) AS bin, hi FROM lim),
    r AS (SELECT p.device_id, CASE WHEN y_true = 0 THEN 'benign' WHEN attack_family = 'gafgyt' AND attack_type IN ('tcp', 'udp')
          THEN 'gafgyt tcp/udp' ELSE 'other attacks' END AS score_group, score::DOUBLE AS v, hi FROM pred p JOIN lim USING (device_id)
          WHERE score >= 0 AND score::DOUBLE <= hi),
    h AS (SELECT r.device_id, score_group, bin, step, count(*) AS n FROM r JOIN edged e ON e.device_id = r.device_id
          AND v >= bin * step AND (v < (bin + 1) * step OR bin = 78) GROUP BY ALL)
    SELECT device_id, score_group, CAST(bin AS INTEGER) AS bin, round(bin * step, 9) AS left_edge, n,
      round(n / (sum(n) OVER (PARTITION BY device_id, score_group) * step), 9) AS density FROM h"""


def draws(source: str, repeats: int, rounding: str, prevalences: list[float], extra: str = "") -> str:
    """CTE drawn(prevalence, repeat, n_attack, tp, fp, tn, fn) over a prediction table."""
    need = f"{rounding}({{p}}::DOUBLE / (1 - {{p}}::DOUBLE) * nb)"
    needs = " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS prevalence, CAST({need.format(p=p)} AS BIGINT) AS n_attack FROM ben" for p in prevalences
    )
    return f"""
    ben AS (SELECT count(*) AS nb, count(*) FILTER (y_pred = 1) AS fp FROM {source} WHERE y_true = 0),
    needs AS ({needs}),
    ranked AS (SELECT repeat, y_pred, row_number() OVER (PARTITION BY repeat ORDER BY md5(row_key || '|' || (repeat + 42))) AS rn
        FROM (SELECT row_key, y_pred, unnest(range(0, {repeats})) AS repeat FROM {source} WHERE y_true = 1)),
    hits AS (SELECT prevalence, repeat, count(*) FILTER (y_pred = 1) AS tp FROM ranked JOIN needs ON rn <= n_attack GROUP BY ALL),
    drawn AS (SELECT prevalence, CAST(repeat AS INTEGER) AS repeat, n_attack, coalesce(tp, 0) AS tp, fp, nb - fp AS tn, n_attack - coalesce(tp, 0) AS fn
        FROM needs CROSS JOIN range(0, {repeats}) t(repeat) CROSS JOIN ben LEFT JOIN hits USING (prevalence, repeat))"""


def sensitivity() -> str:
    m = nine()
    return "SELECT prevalence, " + ", ".join(
        f"round({f}({m[k]}), 9) AS {k}_{n}"
        for k in ("precision", "recall", "fpr", "mcc")
        for n, f in (("mean", "avg"), ("std", "stddev_samp"))
    ) + " FROM drawn GROUP BY prevalence"


def curve(source: str, by: str) -> str:
    return f"""
    cell AS (SELECT {by}, score, CAST(sum(y_true) AS BIGINT) AS pos, count(*) - CAST(sum(y_true) AS BIGINT) AS neg FROM {source} GROUP BY ALL),
    cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS ap, sum(neg) OVER g AS an,
        lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn
        FROM cell WINDOW w AS (PARTITION BY {by} ORDER BY score DESC), g AS (PARTITION BY {by}))"""


def sampled() -> str:
    parts = " UNION ALL ".join(f"SELECT {p}::DOUBLE AS prevalence" for p in PR_PREVALENCES)
    return (
        strategies()
        + f""",
    ord AS (SELECT *, row_number() OVER (PARTITION BY strategy, y_true ORDER BY md5(row_key || '|42')) AS rn,
        count(*) FILTER (y_true = 0) OVER (PARTITION BY strategy) AS nb FROM strat),
    smp AS (SELECT o.* EXCLUDE (rn, nb), prevalence FROM ord o CROSS JOIN ({parts}) p
        WHERE y_true = 0 OR rn <= round_even(prevalence / (1 - prevalence) * nb, 0))"""
    )


def dup_mask(keys: list[str]) -> str:
    return f"WITH {TRAFFIC} SELECT row_key, count(*) OVER (PARTITION BY {', '.join(keys)}) > 1 AS is_duplicate FROM traffic"


def dup_summary(keys: list[str]) -> str:
    return f"""WITH {TRAFFIC}, m AS (SELECT *, count(*) OVER (PARTITION BY {', '.join(keys)}) > 1 AS d FROM traffic)
    SELECT CASE WHEN grouping(device_id) = 1 THEN 'Total' ELSE concat('device_', device_id, ' - ', attack_family) END AS device_family,
      count(*) AS n_samples, count(*) FILTER (d) AS n_duplicates,
      round_even(count(*) FILTER (d)::DOUBLE / count(*)::DOUBLE * 100, 2) AS percent
    FROM m GROUP BY GROUPING SETS ((device_id, attack_family), ())"""


MOMENTS = ", ".join(
    [f"CASE WHEN round(avg({f}::DOUBLE), 6) = 0 THEN 0.0::DOUBLE ELSE round(avg({f}::DOUBLE), 6) END AS mean_{f}" for f in b.FEATURES]
    + [f"round(stddev_pop({f}::DOUBLE), 6) AS std_{f}" for f in b.FEATURES]
)


def scaled(by_device: bool = True) -> str:
    key = "device_id" if by_device else "1"
    stats = ", ".join(f"avg({f}::DOUBLE) AS mean_{f}, stddev_pop({f}::DOUBLE) AS scale_{f}" for f in b.FEATURES)
    cols = ", ".join(
        f"CAST(({f}::DOUBLE - mean_{f}) / CASE WHEN scale_{f} = 0 THEN 1 ELSE scale_{f} END AS FLOAT) AS {f}" for f in b.FEATURES
    )
    on = "s.device_id = p.k" if by_device else "true"
    return f"""{TRAFFIC}, {splits('traffic')},
    params AS (SELECT {key} AS k, {stats} FROM splits WHERE split = 'train' GROUP BY 1),
    scaled AS (SELECT row_key, device_id, split, is_attack, attack_family, attack_type, {cols} FROM splits s JOIN params p ON {on})"""


def uniform(digest: str, nth: int = 0) -> str:
    return f"((('0x' || substr({digest}, {1 + nth * UNIFORM_DIGITS}, {UNIFORM_DIGITS}))::BIGINT)::DOUBLE + 0.5) / {16**UNIFORM_DIGITS}.0::DOUBLE"


def gamma(name: str, part: str, shape: str) -> str:
    """CTE name(device_id, prob_id, repeat, g): first accepted proposal."""
    return f"""
    {name}_m AS (SELECT device_id, prob_id, repeat, i, {shape} - 1.0::DOUBLE / 3.0::DOUBLE AS d,
        md5(concat_ws('|', device_id, prob_id, repeat, 42, '{part}', i)) AS m FROM cells_ CROSS JOIN range(1, {GAMMA_TRIES + 1}) t(i)),
    {name}_x AS (SELECT *, sqrt(ln({uniform('m')}) * -2.0::DOUBLE) * cos({uniform('m', 1)} * (2.0::DOUBLE * 3.141592653589793::DOUBLE)) AS x,
        ln({uniform('m', 2)}) AS lnu, 1.0::DOUBLE / sqrt(d * 9.0::DOUBLE) AS c FROM {name}_m),
    {name}_v AS (SELECT *, (x * c + 1) * (x * c + 1) * (x * c + 1) AS v FROM {name}_x WHERE x * c + 1 > 0),
    {name} AS (SELECT device_id, prob_id, repeat, arg_min(d * v, i) AS g FROM {name}_v
        WHERE lnu < x * x * 0.5::DOUBLE + d - d * v + d * ln(v) GROUP BY ALL)"""


BOOTSTRAP = f"""WITH {SPLIT_SCORES['LOF']},
    val AS (SELECT device_id, score::DOUBLE AS v, row_number() OVER (PARTITION BY device_id ORDER BY score) AS rk FROM splits WHERE split = 'val'),
    sizes AS (SELECT device_id, count(*)::DOUBLE AS n FROM val GROUP BY 1),
    probs(prob_id, prob, criterion) AS (VALUES (0, 0.99::DOUBLE, 'P99'), (1, 0.995::DOUBLE, 'P99.5'), (2, 0.999::DOUBLE, 'P99.9')),
    cells_ AS (SELECT device_id, n, prob_id, prob, criterion, repeat, floor((n - 1) * prob) + 1 AS low
        FROM sizes CROSS JOIN probs CROSS JOIN range(1, 2001) t(repeat)),
    {gamma('ga', 'x', 'low')}, {gamma('gb', 'y', '(n - low + 1)')},
    u AS (SELECT c.*, ga.g / (ga.g + gb.g) AS ul FROM cells_ c JOIN ga USING (device_id, prob_id, repeat) JOIN gb USING (device_id, prob_id, repeat)),
    uu AS (SELECT *, CASE WHEN low < n THEN 1.0 - (1.0 - ul) * pow({uniform("md5(concat_ws('|', device_id, prob_id, repeat, 42, 'z'))")}, 1.0::DOUBLE / (n - low)) ELSE ul END AS uh FROM u),
    q AS (SELECT uu.device_id, criterion, lo.v + (hi.v - lo.v) * ((n - 1) * prob - (low - 1)) AS quantile
        FROM uu JOIN val lo ON lo.device_id = uu.device_id AND lo.rk = greatest(1, ceil(ul * n))
        JOIN val hi ON hi.device_id = uu.device_id AND hi.rk = greatest(1, ceil(uh * n))),
    a AS (SELECT device_id, criterion, avg(quantile) AS m, stddev_samp(quantile) AS s, quantile_cont(quantile, 0.025) AS lo, quantile_cont(quantile, 0.975) AS hi
        FROM q GROUP BY ALL)
    SELECT device_id, criterion, {st('m', 'mean_threshold')}, {st('s', 'std_threshold')}, {st('lo', 'ci_2_5')}, {st('hi', 'ci_97_5')}, {st('s / m', 'cv_threshold')} FROM a"""

# Rows by stage, device and split follow from counts; a scaled train split has mean 0 and deviation 1.
PREPARE = f"""WITH {TRAFFIC}, c AS (SELECT device_id, count(*) FILTER (NOT is_attack) AS b, count(*) FILTER (is_attack) AS a FROM traffic GROUP BY 1),
    parts AS (SELECT device_id, split, n FROM (SELECT device_id, unnest(['train', 'val', 'test_benign', 'test_attack']) AS split, unnest([floor(b * 0.6::DOUBLE)::BIGINT,
      floor(b * (0.6::DOUBLE + 0.2::DOUBLE))::BIGINT - floor(b * 0.6::DOUBLE)::BIGINT, b - floor(b * (0.6::DOUBLE + 0.2::DOUBLE))::BIGINT, a]) AS n FROM c) WHERE n > 0),
    every AS (SELECT 'base' AS stage, device_id, 'all' AS split, count(*) AS n, round(sum(quantity::DOUBLE), 2) AS sum_quantity FROM traffic GROUP BY 2
      UNION ALL SELECT 'splits', device_id, split, n, NULL FROM parts UNION ALL SELECT 'scaled_device', device_id, split, n, NULL FROM parts
      UNION ALL SELECT 'scaled_fleet', 0, split, sum(n)::BIGINT, NULL FROM parts GROUP BY split)
    SELECT *, CASE WHEN split = 'train' AND stage LIKE 'scaled%' THEN 0.0::DOUBLE END AS train_mean, CASE WHEN split = 'train' AND stage LIKE 'scaled%' THEN 1.0::DOUBLE END AS train_std FROM every"""

RECORDS = (
    ROWS
    + """, per_device AS (SELECT device_id, count(*) FILTER (NOT is_attack) AS n_train, count(*) AS n_scored,
      sum(length(row_key) + 16) FILTER (NOT is_attack) AS bytes, sum(l_linenumber) AS work FROM rows_ GROUP BY 1),
    variants(strategy, factor, rate) AS (VALUES ('LOF', 1.0::DOUBLE, 0.0::DOUBLE), ('AE per device', 0.25::DOUBLE, 0.001::DOUBLE), ('AE global', 0.0625::DOUBLE, 0.002::DOUBLE)),
    records AS (SELECT strategy, device_id, n_train, n_scored, bytes * factor / 1048576.0 AS model_size_mb, work * rate AS seconds FROM per_device CROSS JOIN variants)"""
)

FEATURE_SUMS = ", ".join(f"round(sum({f}::DOUBLE), 2) AS sum_{f}" for f in b.FEATURES)
WIN_STATS = ", ".join(
    st(e, n)
    for n, e in {
        "mean": "avg(value)", "std": "stddev_samp(value)", "min": "min(value)", "max": "max(value)",
        "q1": "quantile_cont(value, 0.25)", "q2": "quantile_cont(value, 0.5)", "q3": "quantile_cont(value, 0.75)",
    }.items()
)
SCORE_PARTS = ("current", "optimal")
PIVOT_DEVICES = ", ".join(f"max(recall) FILTER (device_id = {d}) AS device_{d}" for d in EXTREME_DEVICES)

ORACLES = {
    # sources
    "scan_csv": f"WITH {ROWS}, t AS (SELECT *, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, CASE WHEN is_attack THEN concat_ws('.', device_id, attack_family, attack_type, 'csv') ELSE concat_ws('.', device_id, 'benign', 'csv') END AS file_name FROM rows_) SELECT file_name, count(*) AS n, {FEATURE_SUMS} FROM t GROUP BY 1",
    "label_from_filename": f"WITH {TRAFFIC} SELECT DISTINCT file_name, device_id, is_attack, attack_family, attack_type FROM traffic",
    "ingest_by_device": f"WITH {TRAFFIC} SELECT device_id, is_attack, attack_family, attack_type, count(*) AS n, {FEATURE_SUMS} FROM traffic GROUP BY 1, 2, 3, 4",
    "ingest_wide": f"WITH {ROWS} SELECT device_id, is_attack, attack_family, attack_type, count(*) AS n, {', '.join(f'round(sum(l_{f}::DOUBLE), 2) AS sum_{f}' for f in b.FEATURES)} FROM rows_ GROUP BY 1, 2, 3, 4",
    "prepare_run": PREPARE,
    "file_manifest": f"WITH {TRAFFIC} SELECT DISTINCT file_name FROM traffic",
    "file_catalog": f"WITH {CATALOG} SELECT file_name, device, device_name, is_attack, diagnostic, attack_type, n_samples, n_features FROM catalog",
    "scan_projected": "SELECT CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_discount AS FLOAT) AS l_discount FROM lineitem",
    "scores_with_metadata": f"WITH {predictions()} SELECT score, row_key, device_id, is_attack, attack_family, attack_type FROM pred",
    "split_counts": f"WITH {TRAFFIC}, {splits('traffic')} SELECT device_id, split, count(*) AS n_rows FROM splits GROUP BY 1, 2",
    "run_summary_scan": f"WITH {predictions()} SELECT 'fleet' AS experiment, count(*) OVER () AS n_devices, concat('device_', device_id) AS device, count(*) AS n_rows, count(*) FILTER (y_true = 1) AS n_attack, count(*) FILTER (attack_family = 'gafgyt') AS n_gafgyt FROM pred GROUP BY device_id",
    "union_devices": f"WITH {predictions()} SELECT row_key, score, y_true, y_pred, device_id AS device FROM pred",
    "history_scan": f"WITH {HISTORY} SELECT device_id, model_id, epoch, loss, val_loss FROM history",
    # projections and predicates
    "filter_benign": f"WITH {TRAFFIC} SELECT row_key, device_id, attack_type FROM traffic WHERE NOT is_attack",
    "apply_threshold": f"WITH {ALERTS} SELECT event_id, score, CAST(score > CAST(50.01 AS FLOAT) AS TINYINT) AS y_pred FROM alerts",
    "threshold_lookup": f"WITH {ALERTS}, cur(device_id, threshold) AS ({CURRENT}) SELECT event_id, device_id, threshold FROM alerts LEFT JOIN cur USING (device_id)",
    "repredict": f"WITH {predictions()} SELECT device_id, y_true, CAST(score > CAST({case_map('device_id', {d: f'{t - 0.5!r}::DOUBLE' for d, t in b.CURRENT_THRESHOLDS.items()})} AS FLOAT) AS TINYINT) AS y_pred, count(*) AS n FROM pred GROUP BY ALL",
    "score_group": f"WITH {predictions()} SELECT row_key, CASE WHEN y_true = 0 THEN 'benign' WHEN attack_family = 'gafgyt' AND attack_type IN ('tcp', 'udp') THEN 'gafgyt tcp/udp' ELSE 'other attacks' END AS score_group FROM pred",
    "parse_label": f"WITH {TRAFFIC} SELECT concat('device_', device_id, ' - ', attack_family) AS label, concat('device_', device_id) AS device, device_id, attack_family AS family, count(*) AS n FROM traffic GROUP BY ALL",
    "feature_grammar": f"WITH {long_win()}, dim(pos, feature, base, win) AS ({FEATURE_DIM}) SELECT feature, pos, base, win AS \"window\", {st('avg(value)', 'mean')} FROM dim JOIN long_ USING (feature) GROUP BY 1, 2, 3, 4",
    "strategy_union": f"WITH {strategies()} SELECT strategy, row_key, device_id, score, y_true, y_pred FROM strat",
    # splits and samples
    "split_benign": f"WITH {TRAFFIC}, {splits('traffic')} SELECT row_key, device_id, split FROM splits WHERE NOT is_attack",
    "device_splits": f"WITH {TRAFFIC}, {splits('traffic')} SELECT device_id, split, attack_family, count(*) AS n FROM splits GROUP BY ALL",
    "global_splits": f"WITH {TRAFFIC}, {splits('traffic')} SELECT row_key, device_id, split, attack_family, attack_type FROM splits",
    "sample_exact": f"WITH {TRAFFIC} SELECT row_key, device_id FROM (SELECT *, row_number() OVER (ORDER BY md5(row_key || '|42')) AS rn, count(*) OVER () AS n FROM traffic) WHERE rn <= round_even(n * 0.05::DOUBLE, 0)",
    "sample_stratified": f"WITH {TRAFFIC} SELECT row_key, device_id AS device FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY md5(concat_ws('|', row_key, device_id, '42'))) AS rn, count(*) OVER (PARTITION BY device_id) AS n FROM traffic) WHERE rn <= round_even(n * 0.005::DOUBLE, 0)",
    "prevalence_resample": f"WITH {predictions()}, {draws('pred', 30, 'floor', b.PREVALENCES)} SELECT prevalence, repeat, n_attack, tp, fp, tn, fn FROM drawn",
    "prevalence_sample": f"WITH {predictions()}, o AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5(row_key || '|42')) AS rn, count(*) FILTER (y_true = 0) OVER () AS nb FROM pred) SELECT row_key, y_true, y_pred, score FROM o WHERE y_true = 0 OR rn <= round_even(0.05::DOUBLE / (1 - 0.05::DOUBLE) * nb, 0)",
    "bootstrap_threshold": BOOTSTRAP,
    "bootstrap_cv": "SELECT device_id, " + ", ".join(f"max(cv_threshold) FILTER (criterion = '{c}') AS {c.replace('.', '_')}" for c in ("P99", "P99.5", "P99.9")) + f" FROM ({BOOTSTRAP}) GROUP BY 1",
    # profiles
    "structural_summary": f"WITH {CATALOG}, s AS (SELECT count(*) AS n_files, CAST(sum(n_samples) AS BIGINT) AS n_samples, 4::BIGINT AS n_features, count(DISTINCT device) AS n_devices, count(DISTINCT diagnostic) FILTER (is_attack) AS n_families, count(DISTINCT attack_type) FILTER (is_attack) AS n_types FROM catalog) UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value",
    "class_distribution": f"WITH {TRAFFIC} SELECT CASE WHEN is_attack THEN 'attack' ELSE 'benign' END AS class, count(*) AS n_samples, {st('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM traffic)', 'percent')} FROM traffic GROUP BY 1",
    "device_class_pivot": f"WITH {CATALOG} SELECT device, concat(device::VARCHAR, '. ') || device_name AS device_label, CAST(sum(CASE WHEN is_attack THEN 0 ELSE n_samples END) AS BIGINT) AS n_benign, CAST(sum(CASE WHEN is_attack THEN n_samples ELSE 0 END) AS BIGINT) AS n_attack FROM catalog GROUP BY 1, 2",
    "family_share": f"WITH {TRAFFIC} SELECT attack_family AS diagnostic, count(*) AS n_samples, {st('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM traffic WHERE is_attack)', 'percent')} FROM traffic WHERE is_attack GROUP BY 1",
    "attack_type_totals": f"WITH {TRAFFIC} SELECT attack_family || '.' || attack_type AS attack, count(*) AS n_samples FROM traffic WHERE is_attack GROUP BY 1",
    "device_family_pivot": f"WITH {CATALOG} SELECT device, concat(device::VARCHAR, '. ') || device_name AS device_label, {', '.join(f'CAST(coalesce(sum(n_samples) FILTER (diagnostic = {chr(39)}{f}{chr(39)}), 0) AS BIGINT) AS {f}' for f in b.FAMILIES)} FROM catalog GROUP BY 1, 2",
    "missing_profile": f"WITH {TRAFFIC}, c AS (SELECT unnest(['row_key', 'device_id', 'quantity', 'extendedprice', 'discount', 'tax', 'is_attack', 'attack_family', 'attack_type']) AS feature, unnest([{', '.join(f'count(*) FILTER ({x} IS NULL)' for x in ['row_key', 'device_id', 'quantity', 'extendedprice', 'discount', 'tax', 'is_attack', 'attack_family', 'attack_type'])}]) AS n_missing, count(*) AS n FROM traffic) SELECT feature, n_missing, {st('100.0 * n_missing / n', 'percent')}, {st('100.0 * avg(n_missing / n) OVER ()', 'overall_percent')} FROM c",
    "dup_public": dup_mask(DUP_FEATURES + ["device_id", "attack_family", "attack_type"]),
    "dup_device": dup_mask(DUP_FEATURES + ["device_id"]),
    "dup_global": dup_mask(DUP_FEATURES),
    "duplicate_summary": dup_summary(DUP_FEATURES + ["device_id", "attack_family", "attack_type"]),
    "duplicate_summary_device": dup_summary(DUP_FEATURES + ["device_id"]),
    "duplicate_summary_global": dup_summary(["extendedprice", *DUP_FEATURES[:2]]),
    "duplicate_pivot": f"WITH {TRAFFIC}, m AS (SELECT *, count(*) OVER (PARTITION BY {', '.join(DUP_FEATURES)}, device_id) > 1 AS d FROM traffic), p AS (SELECT device_id, attack_family, round_even(count(*) FILTER (d)::DOUBLE / count(*)::DOUBLE * 100, 2) AS pct FROM m GROUP BY 1, 2) SELECT device_id, concat('device_', device_id) AS device, {', '.join(f'max(pct) FILTER (attack_family = {chr(39)}{f}{chr(39)}) AS {f}' for f in b.FAMILIES)} FROM p GROUP BY device_id",
    "feature_variance": f"WITH {long_win()}, v AS (SELECT feature, var_samp(value) AS variance FROM long_ GROUP BY 1) {ends('v', 'variance', 'feature, ' + st('variance'))}",
    "constant_features": f"WITH {long_win()}, v AS (SELECT feature, var_samp(value) AS variance FROM long_ GROUP BY 1) SELECT count(*) FILTER (variance = 0) AS n_constant FROM v",
    "low_variance_profile": f"WITH {long_win()} SELECT feature, count(*) AS count, {WIN_STATS} FROM long_ GROUP BY feature HAVING var_samp(value) < 1",
    "scale_profile": f"WITH {long_win()} SELECT feature, count(*) AS count, {WIN_STATS}, {st('max(value) - min(value)', 'range')}, {st('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')} FROM long_ GROUP BY feature",
    "range_topk": f"WITH {long_win()}, v AS (SELECT feature, min(value) AS min, max(value) AS max, max(value) - min(value) AS range FROM long_ GROUP BY 1) {ends('v', 'range', ', '.join(['feature', st('min'), st('max'), st('range')]))}",
    "iqr_topk": f"WITH {long_win()}, v AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM long_ GROUP BY 1) {ends('v', 'iqr', ', '.join(['feature', st('q1'), st('q3'), st('iqr')]))}",
    "window_correlation": f"WITH {corr_pairs()} SELECT x.base, {st('avg(abs_r)', 'mean')}, {st('quantile_cont(abs_r, 0.5)', 'median')}, {st('min(abs_r)', 'min')}, {st('quantile_cont(abs_r, 0.25)', 'q1')}, {st('quantile_cont(abs_r, 0.75)', 'q3')}, {st('max(abs_r)', 'max')} FROM pairs JOIN dim x ON x.feature = a JOIN dim y ON y.feature = b WHERE x.base = y.base AND x.pos < y.pos GROUP BY 1",
    "feature_correlation": f"WITH {corr_pairs()} SELECT x.win AS \"window\", x.base AS base_i, y.base AS base_j, {st('abs_r')} FROM pairs JOIN dim x ON x.feature = a JOIN dim y ON y.feature = b WHERE x.win = y.win",
    # scores and thresholds
    "score_summary": f"WITH {SPLIT_SCORES['LOF']} SELECT device_id, split, count(*) AS n, {st('avg(score::DOUBLE)', 'mean')}, {st('stddev_pop(score::DOUBLE)', 'std')}, {st('min(score)', 'min')}, {st('max(score)', 'max')}, {st(quant(.5), 'p50')}, {st(quant(.95), 'p95')}, {st(quant(.99), 'p99')}, {st(quant(.995), 'p99_5')} FROM splits WHERE split IN ('train', 'val') GROUP BY 1, 2",
    "boxplot_stats": f"WITH {SPLIT_SCORES['LOF']}, q AS (SELECT device_id, split, {quant(.25)} AS q1, {quant(.5)} AS median, {quant(.75)} AS q3 FROM splits WHERE split IN ('train', 'val') GROUP BY 1, 2), f AS (SELECT q.*, score::DOUBLE AS v, score::DOUBLE BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM q JOIN splits USING (device_id, split)) SELECT device_id, split, {st('any_value(q1)', 'q1')}, {st('any_value(median)', 'median')}, {st('any_value(q3)', 'q3')}, {st('min(v) FILTER (inside)', 'whisker_low')}, {st('max(v) FILTER (inside)', 'whisker_high')}, count(*) FILTER (NOT inside) AS n_fliers FROM f GROUP BY 1, 2",
    "ks_train_val": ks_sql("LOF", True),
    "ks_train_val_global": ks_sql("AE global", False),
    "threshold_criteria": f"WITH {criteria('LOF', 'density')} SELECT device_id, {', '.join(st(f'max(threshold) FILTER (criterion = {chr(39)}{c}{chr(39)})', c) for c in ('p99', 'p99_5', 'p99_9', 'iqr_1_5', 'iqr_3'))} FROM crit GROUP BY 1",
    "threshold_fpr": f"WITH {criteria('LOF', 'density')}, f AS ({FPR_SQL}) SELECT device_id, criterion, {st('threshold')}, {st('fpr')}, {st('fpr * 100', 'fpr_percent')} FROM f",
    "threshold_criteria_reconstruction": f"WITH {criteria('AE per device', 'reconstruction')}, f AS ({FPR_SQL}) SELECT device_id, criterion, {st('threshold')}, {st('fpr')}, {st('fpr * 100', 'fpr_percent')} FROM f",
    "threshold_criteria_fleet": f"WITH {criteria('AE global', 'fleet')}, f AS ({FPR_SQL}) SELECT criterion, {st('threshold')}, {st('fpr')}, {st('round_even(fpr * 100, 2)', 'fpr_percent')} FROM f",
    # evaluation
    "confusion_matrix": f"WITH {predictions()} SELECT CAST(y_true AS INTEGER) AS y_true, CAST(y_pred AS INTEGER) AS y_pred, count(*) AS n, {st('count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY y_true)', 'row_percent')} FROM pred GROUP BY 1, 2, pred.y_true",
    "global_metrics": f"WITH {predictions()}, c AS (SELECT {cells()} FROM pred), m AS (SELECT {metrics()} FROM c) SELECT metric, round_even(value, 4) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)",
    "device_metrics": f"WITH {predictions()}, c AS (SELECT device_id, {cells()} FROM pred GROUP BY 1), m AS (SELECT device_id, {metrics()} FROM c) SELECT *, round(avg(recall) OVER (), 9) AS mean_recall FROM m",
    "family_metrics": f"WITH {predictions()} {detection('attack_family')}",
    "type_metrics": f"WITH {predictions()} SELECT *, attack_family || ' - ' || attack_type AS attack_label FROM ({detection('attack_family, attack_type')})",
    "extreme_type_metrics": f"WITH {predictions()} SELECT *, attack_family || ' - ' || attack_type AS attack_label FROM ({detection('device_id, attack_family, attack_type')}) WHERE device_id IN {tuple(EXTREME_DEVICES)}",
    "extreme_recall_pivot": f"WITH {predictions()} SELECT attack_family || ' - ' || attack_type AS attack_label, {PIVOT_DEVICES}, round(avg(recall), 9) AS mean_recall FROM ({detection('device_id, attack_family, attack_type')}) WHERE device_id IN {tuple(EXTREME_DEVICES)} GROUP BY 1",
    "mcc_threshold": f"WITH {predictions()}, {optimal(**MCC_GRID)} SELECT device_id, {st('threshold')}, {st('mcc')} FROM opt",
    "mcc_threshold_global": f"WITH {predictions('AE global', 'p0')}, pred AS (SELECT * REPLACE (0 AS device_id) FROM p0), {optimal(**FLEET_GRID)} SELECT {st('threshold')}, {st('mcc')} FROM opt",
    "threshold_comparison": f"WITH {predictions()}, {optimal(**MCC_GRID)}, cur(device_id, ct) AS ({CURRENT}), j AS (SELECT p.*, ct, o.threshold AS ot, (score::DOUBLE > ct)::INT AS yc, (score::DOUBLE > o.threshold)::INT AS yo FROM pred p JOIN cur USING (device_id) JOIN opt o USING (device_id)), c AS (SELECT device_id, any_value(ct) AS ct, any_value(ot) AS ot, {cells('y_true', 'yc').replace(' AS ', ' AS current_')}, {cells('y_true', 'yo').replace(' AS ', ' AS optimal_')} FROM j GROUP BY 1) SELECT device_id, round(ct, 9) AS current_threshold, round(ot, 9) AS optimal_threshold, {', '.join(metrics(['recall', 'fpr', 'precision', 'mcc'], w + '_') for w in SCORE_PARTS)} FROM c",
    "threshold_comparison_fleet": f"WITH {predictions('AE global')}, p0 AS (SELECT * REPLACE (0 AS device_id) FROM pred), {optimal(**FLEET_GRID, source='p0', name='o0')}, opt AS (SELECT DISTINCT pred.device_id, o0.threshold FROM pred, o0), cur(device_id, ct) AS ({CURRENT}), j AS (SELECT p.*, ct, o.threshold AS ot, (score::DOUBLE > ct)::INT AS yc, (score::DOUBLE > o.threshold)::INT AS yo FROM pred p JOIN cur USING (device_id) JOIN opt o USING (device_id)), c AS (SELECT device_id, any_value(ct) AS ct, any_value(ot) AS ot, {cells('y_true', 'yc').replace(' AS ', ' AS current_')}, {cells('y_true', 'yo').replace(' AS ', ' AS optimal_')} FROM j GROUP BY 1) SELECT device_id, round(ct, 9) AS current_threshold, round(ot, 9) AS optimal_threshold, {', '.join(metrics(['recall', 'fpr', 'precision', 'mcc'], w + '_') for w in SCORE_PARTS)} FROM c",
    "mcc_threshold_ae": f"WITH {predictions('AE per device')}, {optimal(**AE_GRID)} SELECT device_id, {st('threshold')}, {st('mcc')} FROM opt",
    "score_histogram": histogram(False),
    "score_histogram_zoom": histogram(True),
    "roc_curve": f"WITH {strategies()}, {curve('strat', 'strategy')} SELECT strategy, score::DOUBLE AS threshold, round({ratio('cn', 'an')}, 9) AS fpr, round({ratio('cp', 'ap')}, 9) AS tpr FROM cum WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT DISTINCT strategy, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM strat",
    "roc_auc": f"WITH {strategies()}, {curve('strat', 'strategy')} SELECT strategy, round(sum(neg::DOUBLE * (2 * cp - pos)::DOUBLE) / (any_value(ap)::DOUBLE * any_value(an)::DOUBLE * 2.0), 9) AS auc FROM cum GROUP BY 1",
    "pr_curve": f"WITH {sampled()}, {curve('smp', 'strategy, prevalence')} SELECT strategy, prevalence, score::DOUBLE AS threshold, round({ratio('cp', 'cp + cn')}, 9) AS precision, round({ratio('cp', 'ap')}, 9) AS recall FROM cum UNION ALL SELECT DISTINCT strategy, prevalence, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM smp",
    "average_precision": f"WITH {sampled()}, {curve('smp', 'strategy, prevalence')} SELECT strategy, prevalence, round(sum(pos::DOUBLE * {ratio('cp', 'cp + cn')}) / any_value(ap), 9) AS average_precision FROM cum GROUP BY 1, 2",
    "prevalence_sensitivity": f"WITH {predictions()}, {draws('pred', 30, 'floor', b.PREVALENCES)} {sensitivity()}",
    "recalibrated_prevalence": f"WITH {predictions()}, {optimal(**MCC_GRID)}, again AS (SELECT p.* REPLACE (CAST(score::DOUBLE > threshold AS TINYINT) AS y_pred) FROM pred p JOIN opt USING (device_id)), {draws('again', 30, 'floor', b.PREVALENCES)} {sensitivity()}",
    "operational_metrics": f"WITH {strategies()}, ord AS (SELECT *, row_number() OVER (PARTITION BY strategy, y_true ORDER BY md5(row_key || '|42')) AS rn, count(*) FILTER (y_true = 0) OVER (PARTITION BY strategy) AS nb FROM strat), prev(prevalence) AS (VALUES {', '.join(f'({p}::DOUBLE)' for p in b.PREVALENCES)}), c AS (SELECT strategy, prevalence, {cells()} FROM ord CROSS JOIN prev WHERE y_true = 0 OR rn <= round_even(prevalence / (1 - prevalence) * nb, 0) GROUP BY 1, 2) SELECT strategy, prevalence, {metrics(['precision', 'recall', 'mcc', 'fpr'])}, round({ratio('fp', 'fp + tn')} * 100000, 6) AS fp_per_100k_benign FROM c",
    "strategy_global": f"WITH {strategies()}, c AS (SELECT strategy, {cells()} FROM strat GROUP BY 1) SELECT strategy, {metrics(['mcc', 'recall', 'fpr'])} FROM c",
    "strategy_device_mcc": f"WITH {strategies()}, c AS (SELECT device_id, strategy, {cells()} FROM strat GROUP BY 1, 2), m AS (SELECT device_id, strategy, {metrics(['mcc'])} FROM c) SELECT device_id, {', '.join(f'max(mcc) FILTER (strategy = {chr(39)}{s}{chr(39)}) AS {chr(34)}{s}{chr(34)}' for s in b.STRATEGIES)} FROM m GROUP BY 1",
    "strategy_attack_recall": f"WITH {strategies()}, c AS (SELECT attack_family || ' - ' || attack_type AS attack, strategy, {cells()} FROM strat WHERE y_true = 1 GROUP BY 1, 2), m AS (SELECT attack, strategy, {metrics(['recall'])} FROM c) SELECT attack, {', '.join(f'max(recall) FILTER (strategy = {chr(39)}{s}{chr(39)}) AS {chr(34)}{s}{chr(34)}' for s in b.STRATEGIES)} FROM m GROUP BY 1",
    # run records
    "size_regression": f"WITH {RECORDS} SELECT {st('regr_slope(model_size_mb, n_train::DOUBLE)', 'slope')}, {st('regr_intercept(model_size_mb, n_train::DOUBLE)', 'intercept')}, {st('corr(model_size_mb, n_train::DOUBLE)', 'r')}, {st('regr_r2(model_size_mb, n_train::DOUBLE)', 'r2')} FROM records WHERE strategy = 'LOF'",
    "scalability_table": f"WITH {RECORDS}, s AS (SELECT strategy, sum(model_size_mb) AS mb, count(*) AS n_models, CAST(sum(n_scored) AS BIGINT) AS n_scored, sum(seconds) AS sec FROM records GROUP BY 1) SELECT strategy, {st('mb', 'model_size_mb')}, n_models, n_scored, {st('sec', 'seconds')}, {st('CASE WHEN sec <> 0 THEN n_scored / sec END', 'rows_per_second')} FROM s",
    "training_curves": f"WITH {HISTORY} SELECT model_id, epoch, {st('avg(loss)', 'loss_mean')}, {st('stddev_samp(loss)', 'loss_std')}, {st('avg(val_loss)', 'val_loss_mean')}, {st('stddev_samp(val_loss)', 'val_loss_std')}, count(DISTINCT device_id) AS n_devices FROM history WHERE model_id IN ('click', 'view', 'error') GROUP BY 1, 2",
    "best_epoch": f"WITH {HISTORY} SELECT device_id, model_id, epoch AS best_epoch, val_loss AS best_val_loss FROM (SELECT *, row_number() OVER (PARTITION BY device_id, model_id ORDER BY val_loss, epoch) AS rn FROM history) WHERE rn = 1",
    "best_trial": "WITH trials AS (SELECT CAST(user_id % 9 + 1 AS INTEGER) AS device_id, CAST(event_id % 10 AS INTEGER) AS number, round(max(value), 4) AS value, count(*) AS n_neighbors, max(event_type) AS metric FROM events GROUP BY 1, 2) SELECT device_id, number, value, n_neighbors, metric FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY value, number) AS rn FROM trials) WHERE rn = 1",
    # scaling
    "scaler_fit": f"WITH {TRAFFIC}, {splits('traffic')} " + " UNION ALL ".join(f"SELECT device_id, {i} AS pos, '{f}' AS feature, {st(f'avg({f}::DOUBLE)', 'mean')}, {st(f'CASE WHEN stddev_pop({f}::DOUBLE) = 0 THEN 1 ELSE stddev_pop({f}::DOUBLE) END', 'scale')} FROM splits WHERE split = 'train' GROUP BY device_id" for i, f in enumerate(b.FEATURES)),
    "scaler_apply": f"WITH {scaled()} SELECT row_key, device_id, {', '.join(f'round({f}::DOUBLE, 5) AS {f}' for f in b.FEATURES)} FROM scaled WHERE split = 'train'",
    "scale_splits": f"WITH {scaled()} SELECT device_id, split, count(*) AS n, {MOMENTS} FROM scaled GROUP BY 1, 2",
    "scale_splits_global": f"WITH {scaled(False)} SELECT split, count(*) AS n, {MOMENTS} FROM scaled GROUP BY 1",
    "fleet_report": f"WITH {scaled()}, sc AS (SELECT *, CAST(round(({' + '.join(f'{f}::DOUBLE * {f}::DOUBLE' for f in b.FEATURES)}) / 4, 5) AS FLOAT) AS score FROM scaled), lim AS (SELECT device_id, {quant(.99)} AS t FROM sc WHERE split = 'val' GROUP BY 1), p AS (SELECT device_id, is_attack::INT AS y_true, (score > t::FLOAT)::INT AS y_pred FROM sc JOIN lim USING (device_id) WHERE split LIKE 'test_%'), c AS (SELECT device_id, {cells()} FROM p GROUP BY 1), m AS (SELECT device_id, {metrics()} FROM c) SELECT *, round(avg(recall) OVER (), 9) AS mean_recall FROM m",
}
