"""Independent SQL for the detector queries."""

from __future__ import annotations

from fleetlens.plans import bindings as b
from fleetlens.plans.models import DEVICES, EXACT, EXACT_EPOCHS, K, KNN_K, LOF_CANDIDATES, fixed_weights
from fleetlens.plans.oracles import ALERTS, cells, metrics, splits, st

POINTS = (
    """points0 AS (SELECT vec_id AS id, CAST(vec_id % 3 + 1 AS INTEGER) AS device_id, embedding AS features,
      embedding::DOUBLE[] AS x, label >= 7 AS is_attack, vec_id::VARCHAR AS row_key FROM embeddings),"""
    + splits("points0", "points")
)


def distance(metric: str) -> str:
    if metric == "euclidean":
        return "list_distance(q.x, t.x)"
    return "list_sum(list_transform(range(1, 65), lambda i: abs(q.x[i] - t.x[i])))"


def nearest(name: str, queries: str, train: str, k: int, metric: str, others: bool, points: str = "points") -> str:
    """CTE name(device_id, id, pos, nid, dist)."""
    skip = "AND q.id <> t.id" if others else ""
    return f"""{name} AS (SELECT device_id, id, nid, dist, pos FROM (SELECT *, row_number() OVER (PARTITION BY device_id, id ORDER BY dist, nid) - 1 AS pos
      FROM (SELECT q.device_id, q.id, t.id AS nid, {distance(metric)} AS dist FROM {points} q JOIN {points} t ON q.device_id = t.device_id {skip}
            WHERE ({queries.replace('split', 'q.split')}) AND ({train.replace('split', 't.split')}))) WHERE pos < {k})"""


def fit(name: str, edges: str, k: int) -> str:
    return f"""{name}_k AS (SELECT device_id, id, max(dist) AS kdist FROM {edges} WHERE pos < {k} GROUP BY 1, 2),
    {name} AS (SELECT e.device_id, e.id, any_value(m.kdist) AS kdist, 1.0::DOUBLE / (avg(greatest(e.dist, n.kdist)) + 1e-10) AS lrd, count(*) AS used
      FROM {edges} e JOIN {name}_k n ON n.device_id = e.device_id AND n.id = e.nid
      JOIN {name}_k m ON m.device_id = e.device_id AND m.id = e.id WHERE pos < {k} GROUP BY 1, 2)"""


def factor(name: str, edges: str, model: str, k: int) -> str:
    return f"""{name} AS (SELECT e.device_id, e.id, avg(n.lrd) * (avg(greatest(e.dist, n.kdist)) + 1e-10) AS score
      FROM {edges} e JOIN {model} n ON n.device_id = e.device_id AND n.id = e.nid WHERE pos < {k} AND pos < n.used GROUP BY 1, 2)"""


def sweep(points: str = "points", source: str = POINTS, queries: str = "split = 'val'") -> str:
    """CTEs up to ``trials`` and ``chosen``, and factors s<number> of the rows ``queries`` for every candidate."""
    ctes, union = [], []
    for metric in ("euclidean", "manhattan"):
        widest = max(c["n_neighbors"] for c in LOF_CANDIDATES if c["metric"] == metric)
        ctes += [
            nearest(f"in_{metric}", "split = 'train'", "split = 'train'", widest, metric, True, points),
            nearest(f"out_{metric}", queries, "split = 'train'", widest, metric, False, points),
        ]
    for c in LOF_CANDIDATES:
        n, k, m = c["number"], c["n_neighbors"], c["metric"]
        ctes += [fit(f"m{n}", f"in_{m}", k), factor(f"s{n}", f"out_{m}", f"m{n}", k)]
        union.append(
            f"SELECT device_id, {n} AS number, {k} AS n_neighbors, '{m}' AS metric, round(quantile_cont(score, 0.99), 9) AS value "
            f"FROM s{n} JOIN {points} USING (device_id, id) WHERE split = 'val' GROUP BY 1"
        )
    chosen = "chosen AS (SELECT device_id, number FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY value, number) AS rn FROM trials) WHERE rn = 1)"
    return f"WITH {source}, {', '.join(ctes)}, trials AS ({' UNION ALL '.join(union)}), {chosen}"


def refitted() -> str:
    """Scores (device_id, id, score) of every device's best trial, as a CTE ``best``."""
    each = " UNION ALL ".join(f"SELECT s.* FROM s{c['number']} s JOIN chosen USING (device_id) WHERE number = {c['number']}" for c in LOF_CANDIDATES)
    return f"best AS ({each})"


# Points scaled per device by the train split, as float32.
SCALED = f"""{POINTS}, dims AS (SELECT device_id, id, split, unnest(range(0, 64))::INTEGER AS j, unnest(x) AS v FROM points),
  scaler AS (SELECT device_id, j, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(v) END AS scale FROM dims WHERE split = 'train' GROUP BY 1, 2),
  sdims AS (SELECT d.device_id, d.id, d.split, d.j, CAST((v - mean) / scale AS FLOAT)::DOUBLE AS v FROM dims d JOIN scaler USING (device_id, j)),
  spoints AS (SELECT p.device_id, p.id, p.split, p.is_attack, label, list(s.v ORDER BY s.j) AS x FROM points p JOIN sdims s USING (device_id, id)
    JOIN embeddings e ON e.vec_id = p.id GROUP BY 1, 2, 3, 4, 5)"""


def judged(scores: str) -> str:
    """Predictions of the test rows by the p99 of the validation scores, from a CTE (device_id, id, score)."""
    return f"""fs AS (SELECT p.*, CAST(score AS FLOAT) AS score FROM spoints p JOIN {scores} USING (device_id, id)),
      lim AS (SELECT device_id, quantile_cont(score::DOUBLE, 0.99) AS t FROM fs WHERE split = 'val' GROUP BY 1),
      counts AS (SELECT device_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test_benign') AS n_test_benign,
        count(*) FILTER (split = 'test_attack') AS n_test_attack FROM spoints GROUP BY 1)
      SELECT device_id, round(score::DOUBLE, 4) AS score, is_attack::TINYINT AS y_true, (score > CAST(t AS FLOAT))::TINYINT AS y_pred,
        CASE WHEN label < 7 THEN 'benign' WHEN label = 8 THEN 'gafgyt' ELSE 'mirai' END AS attack_family,
        CASE WHEN label < 7 THEN 'benign' ELSE 'type_' || label END AS attack_type, is_attack, round(t, 4) AS threshold,
        n_train, n_test_benign, n_test_attack, count(*) OVER () AS n_scored
      FROM fs JOIN lim USING (device_id) JOIN counts USING (device_id) WHERE split LIKE 'test_%'"""


def forward(step: int, rows: str) -> list[str]:
    """Long-form CTEs h<step>_<layer>(device_id, id, j, z, v) of the net with parameters w<step>_<layer>, b<step>_<layer>."""
    last, out = len(fixed_weights()) - 1, [f"h{step}_0 AS MATERIALIZED (SELECT device_id, id, split, j, v AS z, v FROM {rows})"]
    for n in range(last + 1):
        value = "z" if n == last else "greatest(z, 0)"
        out.append(
            f"h{step}_{n + 1} AS MATERIALIZED (SELECT device_id, id, split, j, z, {value} AS v FROM (SELECT h.device_id, h.id, h.split, w.j, sum(h.v * w.v) + any_value(c.v) AS z "
            f"FROM h{step}_{n} h JOIN w{step}_{n} w ON w.device_id = h.device_id AND w.i = h.j JOIN b{step}_{n} c ON c.device_id = h.device_id AND c.j = w.j GROUP BY 1, 2, 3, 4))"
        )
    return out


def unrolled(rows: str) -> str:
    """Full-batch gradient steps written out: parameters w<s>_<n>, b<s>_<n> and losses l<s> for s = 0 .. EXACT_EPOCHS."""
    layers, ctes, rate = fixed_weights(), [], EXACT["learning_rate"]
    devices = ", ".join(f"({d})" for d in DEVICES)
    for n, p in enumerate(layers):
        w = ", ".join(f"({i}, {j}, {x!r}::DOUBLE)" for i, line in enumerate(p["w"]) for j, x in enumerate(line))
        c = ", ".join(f"({j}, {x!r}::DOUBLE)" for j, x in enumerate(p["b"]))
        ctes.append(f"w0_{n} AS (SELECT device_id, i, j, v FROM (VALUES {devices}) d(device_id), (VALUES {w}) t(i, j, v))")
        ctes.append(f"b0_{n} AS (SELECT device_id, j, v FROM (VALUES {devices}) d(device_id), (VALUES {c}) t(j, v))")
    for s in range(EXACT_EPOCHS + 1):
        ctes += forward(s, rows)
        ctes.append(
            f"l{s} AS (SELECT device_id, avg(e) FILTER (split = 'train') AS loss, avg(e) FILTER (split = 'val') AS val_loss FROM "
            f"(SELECT y.device_id, y.id, y.split, avg(pow(y.v - x.v, 2)) AS e FROM h{s}_{len(layers)} y JOIN h{s}_0 x USING (device_id, id, j) GROUP BY 1, 2, 3) GROUP BY 1)"
        )
        if s == EXACT_EPOCHS:
            break
        ctes.append(f"n{s} AS (SELECT device_id, count(DISTINCT id) AS n FROM h{s}_0 WHERE split = 'train' GROUP BY 1)")
        for n in reversed(range(len(layers))):
            if n == len(layers) - 1:
                back = f"SELECT y.device_id, y.id, y.j, 2 * (y.v - x.v) / (n * 64) AS g FROM h{s}_{n + 1} y JOIN h{s}_0 x USING (device_id, id, j) JOIN n{s} USING (device_id) WHERE y.split = 'train'"
            else:
                back = (
                    f"SELECT h.device_id, h.id, h.j, CASE WHEN h.z > 0 THEN g ELSE 0 END AS g FROM h{s}_{n + 1} h JOIN (SELECT g.device_id, g.id, w.i AS j, sum(g.g * w.v) AS g "
                    f"FROM g{s}_{n + 1} g JOIN w{s}_{n + 1} w ON w.device_id = g.device_id AND w.j = g.j GROUP BY 1, 2, 3) b USING (device_id, id, j)"
                )
            ctes.append(f"g{s}_{n} AS MATERIALIZED ({back})")
        for n in range(len(layers)):
            ctes.append(
                f"w{s + 1}_{n} AS (SELECT w.device_id, w.i, w.j, w.v - {rate} * d.v AS v FROM w{s}_{n} w JOIN (SELECT g.device_id, h.j AS i, g.j, sum(h.v * g.g) AS v "
                f"FROM g{s}_{n} g JOIN h{s}_{n} h USING (device_id, id) GROUP BY 1, 2, 3) d USING (device_id, i, j))"
            )
            ctes.append(f"b{s + 1}_{n} AS (SELECT c.device_id, c.j, c.v - {rate} * d.v AS v FROM b{s}_{n} c JOIN (SELECT device_id, j, sum(g) AS v FROM g{s}_{n} GROUP BY 1, 2) d USING (device_id, j))")
    return ", ".join(ctes)


def trained_parameters() -> str:
    """(device_id, pos, value) in the order of the flat parameter vector."""
    at, parts = 0, []
    for n, p in enumerate(fixed_weights()):
        width = len(p["b"])
        parts.append(f"SELECT device_id, {at} + i * {width} + j AS pos, v FROM w{EXACT_EPOCHS}_{n}")
        at += len(p["w"]) * width
        parts.append(f"SELECT device_id, {at} + j AS pos, v FROM b{EXACT_EPOCHS}_{n}")
        at += width
    return " UNION ALL ".join(parts)


def exact_scores() -> str:
    last = len(fixed_weights())
    return f"es AS (SELECT y.device_id, y.id, avg(pow(y.v - x.v, 2)) AS score FROM h{EXACT_EPOCHS}_{last} y JOIN h{EXACT_EPOCHS}_0 x USING (device_id, id, j) GROUP BY 1, 2)"


def net() -> str:
    """CTEs lat and rec over all vectors for the net of fixed weights."""
    sql, previous = ["base AS (SELECT vec_id, embedding::DOUBLE[] AS h FROM embeddings)"], "base"
    layers = fixed_weights()
    for no, p in enumerate(layers):
        terms = []
        for j, bias in enumerate(p["b"]):
            column = "[" + ", ".join(repr(row[j]) for row in p["w"]) + "]::DOUBLE[]"
            z = f"list_dot_product(h, {column}) + {bias!r}::DOUBLE"
            terms.append(z if no == len(layers) - 1 else f"greatest(0.0::DOUBLE, {z})")
        sql.append(f"l{no} AS (SELECT vec_id, [{', '.join(terms)}] AS h FROM {previous})")
        previous = f"l{no}"
    last = len(layers) - 1
    sql.append(
        f"""err AS (SELECT e.vec_id, list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i]::DOUBLE - r.h[i], 2))) / 64 AS mse,
      list_sum(list_transform(range(1, 65), lambda i: abs(e.embedding[i]::DOUBLE - r.h[i]))) / 64 AS mae FROM embeddings e JOIN l{last} r USING (vec_id))"""
    )
    return ", ".join(sql)


def principal(rounds: int = 16) -> str:
    """Two leading eigenvectors of the covariance of standardised vectors, by repeated squaring and deflation.

    CTEs z(id, j, v), vec<c>(j, v) with the largest loading positive, and val<c>(v).
    """
    ctes = [
        "raw_ AS (SELECT vec_id AS id, unnest(range(0, 64))::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)",
        "par AS (SELECT j, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(v) END AS scale FROM raw_ GROUP BY 1)",
        "z AS MATERIALIZED (SELECT id, j, CAST((v - mean) / scale AS FLOAT)::DOUBLE AS v FROM raw_ JOIN par USING (j))",
        "cov1 AS MATERIALIZED (SELECT a.j AS i, b.j, covar_samp(a.v, b.v) AS v FROM z a JOIN z b USING (id) GROUP BY 1, 2)",
    ]
    for c in (1, 2):
        ctes.append(f"p{c}_0 AS MATERIALIZED (SELECT * FROM cov{c})")
        for r in range(rounds):
            ctes.append(
                f"p{c}_{r + 1} AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{r} a JOIN p{c}_{r} b ON a.j = b.i GROUP BY 1, 2))"
            )
        last = f"p{c}_{rounds}"
        ctes += [
            f"col{c} AS (SELECT i AS j, v FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1))",
            f"vec{c} AS MATERIALIZED (SELECT j, v / sqrt(sum(v * v) OVER ()) * sign(max_by(v, abs(v)) OVER ()) AS v FROM col{c})",
            f"val{c} AS (SELECT sum(a.v * m.v * b.v) AS v FROM cov{c} m JOIN vec{c} a ON a.j = m.i JOIN vec{c} b ON b.j = m.j)",
            f"cov{c + 1} AS MATERIALIZED (SELECT m.i, m.j, m.v - l.v * a.v * b.v AS v FROM cov{c} m JOIN vec{c} a ON a.j = m.i JOIN vec{c} b ON b.j = m.j, val{c} l)",
        ]
    return ", ".join(ctes)


def cast_score(expr: str) -> str:
    return f"round(CAST({expr} AS FLOAT)::DOUBLE, 4)"


TRAIN, NOT_TRAIN = "split = 'train'", "split <> 'train'"
ALERT_LIMITS = "VALUES " + ", ".join(f"({d}, {40.0 + d}::DOUBLE)" for d in range(1, 10))

ORACLES = {
    "knn_join": f"WITH {POINTS}, {nearest('nn', 'true', 'true', KNN_K, 'euclidean', True)} SELECT device_id, id, CAST(pos AS INTEGER) AS pos, nid AS neighbor, {st('dist')} FROM nn",
    "knn_join_manhattan": f"WITH {POINTS}, {nearest('nn', NOT_TRAIN, TRAIN, KNN_K, 'manhattan', False)} SELECT device_id, id, CAST(pos AS INTEGER) AS pos, nid AS neighbor, {st('dist')} FROM nn",
    "lof_fit": f"WITH {POINTS}, {nearest('nn', TRAIN, TRAIN, K, 'euclidean', True)}, {fit('model', 'nn', K)} SELECT device_id, id, {st('kdist')}, {st('lrd')} FROM model",
    "lof_score": f"WITH {POINTS}, {nearest('nn', TRAIN, TRAIN, K, 'euclidean', True)}, {fit('model', 'nn', K)}, {nearest('qq', 'true', TRAIN, K, 'euclidean', False)}, {factor('f', 'qq', 'model', K)} SELECT device_id, id, {st('score')} FROM f",
    "lof_sweep": f"{sweep()} SELECT device_id, number, n_neighbors, metric, {st('value')} FROM trials",
    "lof_best_trial": f"{sweep()} SELECT device_id, number, {st('value')}, n_neighbors, metric FROM trials JOIN chosen USING (device_id, number)",
    "lof_refit_scores": f"""{sweep(queries="split IN ('train', 'val')")}, {refitted()} SELECT device_id, id, {st('score')}, split FROM best JOIN points USING (device_id, id)""",
    "lof_detect": f"{sweep('spoints', SCALED, 'true')}, {refitted()}, {judged('best')}",
    "ae_train_step": f"WITH {SCALED}, {unrolled('sdims')} SELECT device_id, pos::INTEGER AS pos, CASE WHEN round(v, 7) = 0 THEN 0.0::DOUBLE ELSE round(v, 7) END AS value FROM ({trained_parameters()})",
    "ae_history": f"WITH {SCALED}, {unrolled('sdims')}, "
    + "h AS ("
    + " UNION ALL ".join(f"SELECT a.device_id, {s + 1} AS epoch, a.loss, z.val_loss FROM l{s} a JOIN l{s + 1} z USING (device_id)" for s in range(EXACT_EPOCHS))
    + f") SELECT device_id, 'model' AS config_id, epoch, round(loss, 7) AS loss, round(val_loss, 7) AS val_loss, {EXACT['learning_rate']}::DOUBLE AS learning_rate FROM h",
    "ae_detect": f"WITH {SCALED}, {unrolled('sdims')}, {exact_scores()}, {judged('es')}",
    "pca_2d": f"WITH {principal()} SELECT vec_id, label >= 7 AS is_attack, round(sum(z.v * a.v), 6) AS pc1, round(sum(z.v * b.v), 6) AS pc2 FROM embeddings JOIN z ON z.id = vec_id JOIN vec1 a USING (j) JOIN vec2 b USING (j) GROUP BY 1, 2",
    "pca_variance": f"WITH {principal()}, whole AS (SELECT sum(v) AS t FROM cov1 WHERE i = j), each_ AS (SELECT 'PC1' AS component, v FROM val1 UNION ALL SELECT 'PC2', v FROM val2) SELECT component, {st('v / t', 'ratio')}, {st('v / t * 100', 'percent')} FROM each_, whole",
    "pca_total_variance": "SELECT round(64.0 * count(*) / (count(*) - 1), 4) AS total_variance FROM embeddings",
    "ae_reconstruct": f"WITH {net()}, o AS (SELECT vec_id, unnest(range(0, 64))::INTEGER AS pos, round(CAST(unnest(h) AS FLOAT)::DOUBLE, 4) AS v FROM l3) SELECT vec_id, pos, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE v END AS value FROM o",
    "ae_encode": f"WITH {net()} SELECT vec_id, unnest(range(0, 3))::INTEGER AS pos, round(CAST(unnest(h) AS FLOAT)::DOUBLE, 4) AS value FROM l1",
    "ae_score_mse": f"WITH {net()} SELECT vec_id, {cast_score('mse')} AS score FROM err",
    "ae_score_mae": f"WITH {net()} SELECT vec_id, {cast_score('mae')} AS score FROM err",
    "ae_score_rmse": f"WITH {net()} SELECT vec_id, {cast_score('sqrt(mse)')} AS score FROM err",
    "score_predictions": f"WITH {POINTS}, {net()}, sc AS (SELECT p.*, CAST(mse AS FLOAT) AS score FROM points p JOIN err ON err.vec_id = p.id), lim AS (SELECT device_id, quantile_cont(score::DOUBLE, 0.99) AS t FROM sc WHERE split = 'val' GROUP BY 1) SELECT id, device_id, round(score::DOUBLE, 4) AS score, CAST(is_attack AS TINYINT) AS y_true, CAST(score > CAST(t AS FLOAT) AS TINYINT) AS y_pred FROM sc JOIN lim USING (device_id) WHERE split LIKE 'test_%'",
    "stream_score": f"WITH {ALERTS}, lim(device_id, t) AS ({ALERT_LIMITS}) SELECT event_id, device_id, score, y_true, CAST(score > CAST(t AS FLOAT) AS TINYINT) AS y_pred FROM alerts JOIN lim USING (device_id)",
    "alert_metrics": f"WITH {ALERTS}, lim(device_id, t) AS ({ALERT_LIMITS}), p AS (SELECT device_id, y_true, (score > CAST(t AS FLOAT))::INT AS y_pred FROM alerts JOIN lim USING (device_id)), c AS (SELECT device_id, {cells()} FROM p GROUP BY 1), m AS (SELECT device_id, {metrics()} FROM c) SELECT *, round(avg(recall) OVER (), 9) AS mean_recall FROM m",
}
