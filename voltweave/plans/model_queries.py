"""Queries over the graphical VAR: design, cross products, priors, scores, residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltweave.functions.fixed import MODEL
from voltweave.operators import bayes, draws, graphs, panel, scores
from voltweave.plans import bindings as b
from voltweave.plans import draw_sql as q
from voltweave.plans.registry import query, rounded
from voltweave.runtime import cut

# Ten areas: daily purchases are the endogenous series, all other events the exogenous ones.
DIMS = bayes.Dims(ny=10, nz=10, lags=(1, 7))

MODEL_SQL = """
raw AS (SELECT ts::DATE AS date, (user_id % 10)::INT AS idx,
               CASE event_type WHEN 'purchase' THEN 'endo' ELSE 'exog' END AS block, sum(value) AS v
        FROM events GROUP BY ALL),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT ts::DATE AS date FROM events)),
bal AS (SELECT t, s.idx, s.block, coalesce(v, 0) AS v FROM (SELECT DISTINCT idx, block FROM raw) s CROSS JOIN days
        LEFT JOIN raw ON raw.date = days.date AND raw.idx = s.idx AND raw.block = s.block),
zz AS (SELECT t, idx, block, (v - avg(v) OVER (PARTITION BY idx, block)) / stddev_samp(v) OVER (PARTITION BY idx, block) AS z FROM bal),
lagged AS (SELECT t - 7 AS t, idx AS col, z AS x FROM zz WHERE block = 'endo'
           UNION ALL SELECT t + lag - 7, 10 + (lag > 1)::INT * 20 + CASE block WHEN 'exog' THEN 10 ELSE 0 END + idx, z
           FROM zz CROSS JOIN (VALUES (1), (7)) l(lag)),
design AS (SELECT t, col, x FROM lagged WHERE t >= 0 AND t < (SELECT count(*) - 7 FROM days)),
nobs AS (SELECT count(*) - 7 AS n FROM days),
gram AS (SELECT a.col AS a, b.col AS b, sum(a.x * b.x) AS s FROM design a JOIN design b USING (t) GROUP BY ALL)"""


def _series(spark, sf):
    """Balanced standardised panel: date, block, idx, value."""
    ev = b.table(spark, sf, "events")
    daily = ev.groupBy(
        F.to_date("ts").alias("date"), (F.col("user_id") % 10).cast("int").alias("idx"),
        F.when(F.col("event_type") == "purchase", "endo").otherwise("exog").alias("block"),
    ).agg(F.sum("value").alias("value"))
    filled = panel.on_calendar(daily, b.calendar(spark, sf)).fillna(0.0, ["value"])
    return panel.standardise(filled, ["idx", "block"], strict=False).select(
        "date", "block", "idx", F.col("z").alias("value"))


def _design(spark, sf):
    """Design rows, one per day; kept, since most queries read them several times."""
    z = cut(_series(spark, sf))
    return cut(bayes.design_rows(
        bayes.day_vectors(z.where("block = 'endo'")), bayes.day_vectors(z.where("block = 'exog'")), DIMS))


def _cells(design):
    whole = bayes.gram(design.withColumn("k", F.lit(0)), ["k"])
    return bayes.gram_cells(whole, DIMS.width, [])


def _days(spark, sf):
    return b.calendar(spark, sf).count() - max(DIMS.lags)


@query("b9_stacked_design", f"WITH {MODEL_SQL} SELECT t::INT AS t, col::INT AS col, round(x, 6) AS x FROM design")
def stacked_design(spark, sf):
    return rounded(_design(spark, sf).select("t", F.posexplode("d").alias("col", "x")), 6, "x")


@query("a38_gram", f"WITH {MODEL_SQL} SELECT a::INT AS a, b::INT AS b, round(s, 6) AS s FROM gram")
def gram(spark, sf):
    return rounded(_cells(_design(spark, sf)), 6, "s")


@query("a38_weighted_gram", f"""WITH {MODEL_SQL}, h AS (SELECT t, avg(x) AS h FROM design WHERE col < 10 GROUP BY t)
SELECT a.col::INT AS a, b.col::INT AS b, round(sum(a.x * b.x * exp(-h)), 6) AS s
FROM design a JOIN design b USING (t) JOIN h USING (t) GROUP BY ALL""")
def weighted_gram(spark, sf):
    rows = _design(spark, sf).withColumn("k", F.lit(0)).withColumn("w", F.exp(-F.aggregate(
        F.slice("d", 1, DIMS.ny), F.lit(0.0), lambda a, v: a + v) / DIMS.ny))
    return rounded(bayes.gram_cells(bayes.gram(rows, ["k"], "d", "w"), DIMS.width, []), 6, "s")


@query("b1_minnesota_variances", f"""WITH {MODEL_SQL}, v AS (SELECT DISTINCT block, idx FROM bal)
SELECT block, idx, lag, round(CASE block WHEN 'endo' THEN 0.001 / lag ** 2 ELSE 0.001 * 0.5 / ord ** 2 END, 10) AS omega
FROM v CROSS JOIN (VALUES (1, 1), (7, 2)) l(lag, ord)""")
def minnesota_variances(spark, sf):
    lags = F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.lit(o + 1).alias("lag_ordinal")) for o, k in enumerate(DIMS.lags)]))
    rows = _series(spark, sf).select("block", "idx").distinct().select("block", "idx", lags.alias("_l")).select(
        "block", "idx", "_l.lag", "_l.lag_ordinal")
    table = bayes.minnesota_table(rows, MODEL["pi_shrink"], MODEL["lag_decay"], MODEL["exog_weight"])
    return rounded(table.drop("lag_ordinal"), 10, "omega")


def _prior_scale(spark, sf):
    endo = _series(spark, sf).where("block = 'endo'")
    return panel.ar1_residual_variance(endo, ["idx"], max(DIMS.lags))


@query("b2_prior_scale", f"""WITH {MODEL_SQL}, p AS (SELECT idx, z AS y, lag(z) OVER w AS x, t FROM zz WHERE block = 'endo'
WINDOW w AS (PARTITION BY idx ORDER BY t)), f AS (SELECT idx, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p WHERE t >= 7 GROUP BY idx)
SELECT idx, round(var_pop(y - i - s * x), 6) AS sigma2, 12 AS df FROM p JOIN f USING (idx) WHERE t >= 7 GROUP BY idx""")
def prior_scale(spark, sf):
    table = _prior_scale(spark, sf).withColumn("df", F.lit(DIMS.ny + MODEL["alpha_offset"]))
    return rounded(table, 6, "sigma2")


def _score_sql(alpha: str, width: int, where: str) -> str:
    """Gain of a single parent in DuckDB, with the constants written out."""
    def offset(n: int) -> str:
        g = " + ".join(f"lgamma((al + n) / 2 - {k} / 2.0) - lgamma(al / 2 - {k} / 2.0)" for k in range(n))
        return f"(-{n} * n / 2.0 * ln(pi()) + {g} + al / 2 * {n} * ln(c0))"

    return f"""WITH {MODEL_SQL}, al AS (SELECT n, greatest({alpha}, n // 4)::DOUBLE AS al FROM nobs),
k AS (SELECT n, al, CASE WHEN al - {width} - 1 > 0 THEN al - {width} - 1 ELSE 1 END AS c0 FROM al)
SELECT g.a::INT AS a, g.b::INT AS b, round({offset(2)} - 2 * {offset(1)} - (al + n) / 2 *
  (ln((x.s + c0) * (y.s + c0) - g.s * g.s) - ln(x.s + c0) - ln(y.s + c0)), 6) AS gain
FROM gram g JOIN gram x ON x.a = g.a AND x.b = g.a JOIN gram y ON y.a = g.b AND y.b = g.b CROSS JOIN k
WHERE g.a < 10 AND g.a <> g.b AND {where}"""


@query("b7_contemporaneous_scores", _score_sql("12", 10, "g.b < 10"))
def contemporaneous_scores(spark, sf):
    score = bayes.BlockScore.contemporaneous(DIMS.ny, _days(spark, sf))
    return rounded(bayes.single_edge_scores(_cells(_design(spark, sf)), score, DIMS.ny, F.col("b") < DIMS.ny), 6, "gain")


@query("b10_temporal_scores", _score_sql("43", 50, "g.b >= 10"))
def temporal_scores(spark, sf):
    score = bayes.BlockScore.temporal(DIMS, _days(spark, sf))
    return rounded(bayes.single_edge_scores(_cells(_design(spark, sf)), score, DIMS.ny, F.col("b") >= DIMS.ny), 6, "gain")


# Coefficients for the residual queries: each response's regression on its own first lag.
COEF_SQL = MODEL_SQL + """,
coef AS (SELECT g.a AS i, g.b AS col, g.s / d.s AS coef FROM gram g JOIN gram d ON d.a = g.b AND d.b = g.b
         WHERE g.a < 10 AND g.b = g.a + 10),
u AS (SELECT y.t, y.col AS i, y.x - coalesce(coef * x.x, 0) AS u FROM design y LEFT JOIN coef ON coef.i = y.col
      LEFT JOIN design x ON x.t = y.t AND x.col = coef.col WHERE y.col < 10),
prec AS (SELECT a AS i, b AS j, s / n AS p FROM gram CROSS JOIN nobs WHERE a < 10 AND b < 10),
qf AS (SELECT u.t, greatest(sum(u.u * p * v.u), 1e-12) AS q FROM u JOIN prec USING (i) JOIN u v ON v.t = u.t AND v.i = prec.j GROUP BY u.t),
hp AS (SELECT t, avg(x) AS h FROM design WHERE col < 10 GROUP BY t)"""


def _coefs(cells):
    diag = cells.where("a = b").select(F.col("a").alias("b"), F.col("s").alias("_d"))
    return cells.where((F.col("a") < DIMS.ny) & (F.col("b") == F.col("a") + DIMS.ny)).join(diag, "b").select(
        F.col("a").alias("i"), F.col("b").alias("col"), (F.col("s") / F.col("_d")).alias("coef"))


def _path(design):
    return design.select("t", (F.aggregate(
        F.slice("d", 1, DIMS.ny), F.lit(0.0), lambda a, v: a + v) / DIMS.ny).alias("h"))


@query("b12_residuals", f"""WITH {COEF_SQL} SELECT t::INT AS t, i::INT AS i, round(u, 6) AS u,
round(u / exp(h / 2), 6) AS u_scaled FROM u JOIN hp USING (t)""")
def residuals(spark, sf):
    design = _design(spark, sf)
    u = bayes.residual_rows(design, _coefs(_cells(design)), DIMS)
    rows = bayes.scaled_residuals(u, _path(design))
    return rounded(rows.select("t", "i", "u", "u_scaled"), 6, "u", "u_scaled")


def _forms(design, n):
    cells = cut(_cells(design))
    precision = cells.where((F.col("a") < DIMS.ny) & (F.col("b") < DIMS.ny)).select(
        F.col("a").alias("i"), F.col("b").alias("j"), (F.col("s") / n).alias("p"))
    return bayes.quadratic_forms(cut(bayes.residual_rows(design, _coefs(cells), DIMS)), precision)


@query("b19_quadratic_forms", f"WITH {COEF_SQL} SELECT t::INT AS t, round(q, 6) AS q FROM qf")
def quadratic_forms(spark, sf):
    return rounded(_forms(_design(spark, sf), _days(spark, sf)), 6, "q")


@query("b16_volatility_target", f"""WITH {COEF_SQL}, hh AS (SELECT t, h, q, lag(h) OVER w AS hb, lead(h) OVER w AS ha
FROM hp JOIN qf USING (t) WINDOW w AS (ORDER BY t))
SELECT t::INT AS t, round(-0.5 * 10 * h - 0.5 * q * exp(-h) + CASE WHEN hb IS NULL THEN -0.5 * h ** 2 / 10 ELSE -0.5 * (h - hb) ** 2 / 0.1 END
+ coalesce(-0.5 * (ha - h) ** 2 / 0.1, 0), 6) AS log_target FROM hh""")
def volatility_target(spark, sf):
    design = _design(spark, sf)
    path = _path(design).join(_forms(design, _days(spark, sf)), "t").withColumn("chain", F.lit(0))
    table = bayes.volatility_log_target(path, ["chain"], DIMS.ny, MODEL["sigma_h2_start"], MODEL["v_h0"])
    return rounded(table.select("t", "log_target"), 6, "log_target")


@query("b18_innovation_posterior", f"""WITH {COEF_SQL}, e AS (SELECT h - lag(h) OVER (ORDER BY t) AS eta FROM hp)
SELECT 10 + count(eta) / 2 AS shape, round(0.01 + 0.5 * sum(eta * eta), 6) AS scale FROM e""")
def innovation_posterior(spark, sf):
    path = _path(_design(spark, sf)).withColumn("chain", F.lit(0))
    table = bayes.innovation_posterior(path, ["chain"], MODEL["ig_shape"], MODEL["ig_scale"])
    return rounded(table.drop("chain"), 6, "scale")


# ---- scores of whole graphs ---------------------------------------------------------------------

# One series per node of the draws' graphs: all events of the users of a node.
NODE_SQL = """
nraw AS (SELECT ts::DATE AS date, (user_id % 8)::INT AS idx, sum(value) AS v FROM events GROUP BY ALL),
nday AS (SELECT DISTINCT ts::DATE AS date FROM events),
nbal AS (SELECT date, idx, coalesce(v, 0) AS v FROM (SELECT DISTINCT idx FROM nraw) CROSS JOIN nday LEFT JOIN nraw USING (date, idx)),
nz AS (SELECT date, idx, (v - avg(v) OVER (PARTITION BY idx)) / stddev_samp(v) OVER (PARTITION BY idx) AS z FROM nbal),
gram AS (SELECT a.idx AS a, b.idx AS b, sum(a.z * b.z) AS s FROM nz a JOIN nz b USING (date) GROUP BY ALL),
al AS (SELECT count(*) AS n, greatest(10, count(*) // 4)::DOUBLE AS al FROM nday)"""

OFFSET_SQL = """(-({m}) * n / 2.0 * ln(pi()) + coalesce(list_sum([lgamma((al + n) / 2 - k / 2.0) - lgamma(al / 2 - k / 2.0) for k in range({m})]), 0)
  + al / 2 * ({m}) * ln(c0))"""


def _pivots_sql(longest: int) -> str:
    """Pivots of the elimination of every list in ``blocks`` (in its own order), CTE piv(block, p, s)."""
    steps = [f"""
m{t} AS (SELECT m.block, m.p, m.q, m.s - r.s * c.s / d.s AS s FROM m{t - 1} m
  JOIN m{t - 1} r ON r.block = m.block AND r.p = {t} AND r.q = m.q JOIN m{t - 1} c ON c.block = m.block AND c.q = {t} AND c.p = m.p
  JOIN m{t - 1} d ON d.block = m.block AND d.p = {t} AND d.q = {t} WHERE m.p > {t} AND m.q > {t})""" for t in range(1, longest)]
    pivots = " UNION ALL ".join(f"SELECT block, p, s FROM m{t - 1} WHERE p = {t} AND q = {t}" for t in range(1, longest + 1))
    return f"""
e AS (SELECT block, unnest(block) AS v, unnest(range(1, len(block) + 1)) AS p FROM blocks),
m0 AS (SELECT x.block, x.p, y.p AS q, g.s + CASE WHEN x.p = y.p THEN c0 ELSE 0 END AS s
  FROM e x JOIN e y USING (block) JOIN gram g ON g.a = x.v AND g.b = y.v CROSS JOIN k),{",".join(steps)}{"," if steps else ""}
piv AS ({pivots})"""


BLOCK_SQL = f"""{q.DRAWS}, {NODE_SQL}, k AS (SELECT n, al, CASE WHEN al - 9 > 0 THEN al - 9 ELSE 1 END AS c0 FROM al),
sets AS (SELECT chain, draw, i AS node, coalesce(list(j ORDER BY j) FILTER (WHERE g = 1 AND i <> j), []) AS parents FROM g0 GROUP BY ALL),
blocks AS (SELECT parents AS block FROM sets WHERE len(parents) > 0 UNION SELECT list_sort(list_append(parents, node)) FROM sets),
{_pivots_sql(8)},
marginal AS (SELECT block, {OFFSET_SQL.format(m="len(block)")} - (al + n) / 2 * sum(ln(s)) AS lm FROM piv CROSS JOIN k GROUP BY block, n, al, c0)"""


def _node_series(spark, sf):
    """Balanced standardised series of the nodes: date, idx, z."""
    ev = b.table(spark, sf, "events")
    daily = ev.groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % b.G0.rows).cast("int").alias("idx")).agg(F.sum("value").alias("value"))
    return panel.standardise(panel.on_calendar(daily, b.calendar(spark, sf)).fillna(0.0, ["value"]), ["idx"], strict=False)


def _node_matrix(spark, sf):
    """Cross products of the node series plus the prior scale, and the constants of the scores."""
    z = _node_series(spark, sf)
    rows = bayes.day_vectors(z.select("date", "idx", F.col("z").alias("value"))).withColumn("k", F.lit(0))
    cells = bayes.gram_cells(bayes.gram(rows, ["k"], "v"), b.G0.rows, [])
    score = bayes.BlockScore.contemporaneous(b.G0.rows, b.calendar(spark, sf).count())
    return scores.matrix_of(cells, b.G0.rows) + score.c0 * np.eye(b.G0.rows), score


@query("b6_block_marginals", f"""WITH {BLOCK_SQL} SELECT array_to_string(block, ',') AS block, len(block) AS n,
round(lm, 6) AS log_marginal FROM marginal""")
def block_marginals(spark, sf):
    """Every block of variables that a draw's graph needs: each node's parents, with and without the node."""
    post, score = _node_matrix(spark, sf)
    sets = scores.parent_sets(b.draws(spark, sf), "g", b.G0.rows)
    both = F.explode(F.array("parents", F.array_sort(F.array_append("parents", F.col("node")))))
    found = scores.block_marginals(sets.select(both.alias("block")).where("size(block) > 0").distinct(), post, score)
    return rounded(found.select(F.array_join("block", ",").alias("block"), F.size("block").cast("long").alias("n"), "log_marginal"), 6, "log_marginal")


@query("b7_graph_scores", f"""WITH {BLOCK_SQL} SELECT chain, draw, node::INT AS node, len(parents) AS n_parents, round(f.lm - coalesce(o.lm, 0), 6) AS score
FROM sets JOIN marginal f ON f.block = list_sort(list_append(parents, node)) LEFT JOIN marginal o ON o.block = parents""")
def graph_scores(spark, sf):
    """Local score of every node of every draw's graph."""
    post, score = _node_matrix(spark, sf)
    found = scores.local_scores(scores.parent_sets(b.draws(spark, sf), "g", b.G0.rows), post, score)
    return rounded(found.select("chain", "draw", "node", F.size("parents").cast("long").alias("n_parents"), "score"), 6, "score")


# Parents of a response: its strongest 0 to 3 cross products with a lagged column.
TOGGLE_SQL = f"""{MODEL_SQL}, al AS (SELECT n, greatest(43, n // 4)::DOUBLE AS al FROM nobs),
k AS (SELECT n, al, CASE WHEN al - 51 > 0 THEN al - 51 ELSE 1 END AS c0 FROM al),
best AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(abs(s), 6) DESC, b) AS rn FROM gram WHERE a < 10 AND b >= 10),
sets AS (SELECT a AS response, size, coalesce(list(b ORDER BY b) FILTER (WHERE rn <= size), []) AS parents
         FROM best CROSS JOIN (SELECT unnest(range(4)) AS size) GROUP BY ALL),
toggled AS (SELECT response, size, parents, c AS col, CASE WHEN list_contains(parents, c) THEN list_filter(parents, lambda x: x <> c)
            ELSE list_sort(list_append(parents, c)) END AS other FROM sets CROSS JOIN (SELECT unnest(range(10, 50)) AS c)),
blocks AS (SELECT list_append(parents, response) AS block FROM sets UNION SELECT list_append(other, response) FROM toggled),
{_pivots_sql(5)},
own AS (SELECT block, {OFFSET_SQL.format(m="len(block)")} - {OFFSET_SQL.format(m="(len(block) - 1)")} - (al + n) / 2 * ln(s) AS score
        FROM piv CROSS JOIN k WHERE p = len(block))"""


@query("b10_toggle_gains", f"""WITH {TOGGLE_SQL} SELECT response::INT AS response, size, col::INT AS col, list_contains(parents, col) AS leaves,
round(t.score - o.score, 6) AS gain FROM toggled JOIN own t ON t.block = list_append(other, response) JOIN own o ON o.block = list_append(parents, response)""")
def toggle_gains(spark, sf):
    """Gain of every lagged column's toggle for parent sets of 0 to 3 columns per response."""
    score = bayes.BlockScore.temporal(DIMS, _days(spark, sf))
    cells = cut(_cells(_design(spark, sf)))
    ranked = cells.where((F.col("a") < DIMS.ny) & (F.col("b") >= DIMS.ny)).groupBy(F.col("a").alias("response")).agg(
        F.array_sort(F.collect_list(F.struct((-F.round(F.abs("s"), 6)).alias("_s"), "b"))).alias("_best"))
    sets = ranked.select("response", F.col("_best.b").alias("_best"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("size"))
    sets = sets.select("response", "size", F.array_sort(F.slice("_best", F.lit(1), F.col("size").cast("int"))).alias("parents"))
    post = scores.matrix_of(cells, DIMS.width) + score.c0 * np.eye(DIMS.width)
    gains = scores.toggle_gains(sets, post, score, range(DIMS.ny, DIMS.width))
    return rounded(gains.select(
        "response", "size", F.col("column").alias("col"), F.array_contains("parents", F.col("column")).alias("leaves"), "gain"), 6, "gain")


# Contemporaneous edges of a draw run along an order of the nodes that turns with the draw, so there is no cycle.
_REDUCED = "".join(f""",
t{k} AS (SELECT nw.chain, nw.draw, nw.i, t.m, sum(nw.v * t.v) AS v FROM nw JOIN t{k - 1} t ON t.chain = nw.chain AND t.draw = nw.draw AND t.i = nw.j GROUP BY ALL)"""
                   for k in range(1, 8))


@query("b11_reduced_form", f"""WITH {q.DRAWS}, nw AS (SELECT chain, draw, i, j, g * x AS v FROM g0 WHERE (j + draw) % 8 < (i + draw) % 8),
t0 AS (SELECT chain, draw, i, j AS m, g * x AS v FROM g0){_REDUCED},
every AS ({" UNION ALL ".join(f"SELECT chain, i, m, v FROM t{k}" for k in range(8))})
SELECT chain, i::INT AS i, m::INT AS j, round(sum(v) / max(n_keep), 6) AS mean FROM every CROSS JOIN nk GROUP BY chain, i, m""")
def reduced_form(spark, sf):
    """Mean reduced-form coefficients per chain, from the contemporaneous and the lagged part of every draw."""
    n = b.G0.rows
    d = b.draws(spark, sf).withColumn("lagged", draws.masked("g", "x"))
    ahead = lambda k, turn: (F.floor(k) + turn) % n
    now = F.transform("lagged", lambda v, k: F.when(ahead(k % n, F.col("draw")) < ahead(k / n, F.col("draw")), v).otherwise(0.0))

    def work(contemporaneous, lagged):
        return [scores.reduced_form(contemporaneous.reshape(-1, n, n), lagged.reshape(-1, n, n)).reshape(len(lagged), -1).tolist()]

    found = graphs.map_matrices(d.withColumn("now", now), ["now", "lagged"], "a array<double>", work)
    cells = found.select("chain", F.posexplode("a").alias("cell", "value")).groupBy("chain", "cell").agg(F.avg("value").alias("mean"))
    return rounded(b.G0.locate(cells).select("chain", "i", "j", "mean"), 6, "mean")


# Residuals of every node series about its own first lag, and their covariance.
RESIDUAL_SQL = f"""{q.DRAWS}, {NODE_SQL},
np AS (SELECT date, idx, z, lag(z) OVER (PARTITION BY idx ORDER BY date) AS z1 FROM nz),
ns AS (SELECT idx, sum(z * z1) / sum(z1 * z1) AS slope FROM np WHERE z1 IS NOT NULL GROUP BY idx),
nu AS (SELECT date, idx, z - slope * z1 AS u FROM np JOIN ns USING (idx) WHERE z1 IS NOT NULL),
sigma AS (SELECT a.idx AS a, b.idx AS b, sum(a.u * b.u) / max(al.n - 1) AS s FROM nu a JOIN nu b USING (date) CROSS JOIN al GROUP BY a.idx, b.idx),
sets AS (SELECT chain, draw, i AS node, list_append(coalesce(list(j ORDER BY j) FILTER (WHERE g = 1 AND i <> j), []), i) AS block FROM g0 GROUP BY chain, draw, i),
e AS (SELECT block, unnest(block) AS v, unnest(range(1, len(block) + 1)) AS p FROM (SELECT DISTINCT block FROM sets)),
m0 AS (SELECT x.block, x.p, x.v, y.p AS q, s FROM e x JOIN e y USING (block) JOIN sigma g ON g.a = x.v AND g.b = y.v),""" + ",".join(f"""
m{t} AS (SELECT m.block, m.p, m.v, m.q, CASE WHEN m.p = {t} THEN m.s / d.s ELSE m.s - c.s * r.s / d.s END AS s
  FROM m{t - 1} m JOIN m{t - 1} d ON d.block = m.block AND d.p = {t} AND d.q = {t} JOIN m{t - 1} r ON r.block = m.block AND r.p = {t} AND r.q = m.q
  JOIN m{t - 1} c ON c.block = m.block AND c.p = m.p AND c.q = {t} WHERE m.q > {t} AND len(m.block) > {t})""" for t in range(1, 8)) + """,
solved AS (""" + " UNION ALL ".join(f"SELECT block, p, v, s FROM m{t} WHERE len(block) = {t + 1} AND q = {t + 1}" for t in range(8)) + """)"""


def _structural(spark, sf):
    """Different parent sets of the draws' graphs with their number of draws, coefficients and variance."""
    z = _node_series(spark, sf)
    pairs = z.withColumn("x", F.lag("z").over(Window.partitionBy("idx").orderBy("date"))).where("x IS NOT NULL")
    slopes = pairs.groupBy("idx").agg((F.sum(F.col("z") * F.col("x")) / F.sum(F.col("x") ** 2)).alias("slope"))
    u = pairs.join(slopes, "idx").select("date", "idx", (F.col("z") - F.col("slope") * F.col("x")).alias("value"))
    cells = bayes.gram_cells(bayes.gram(bayes.day_vectors(u).withColumn("k", F.lit(0)), ["k"], "v"), b.G0.rows, [])
    sigma = scores.matrix_of(cells, b.G0.rows) / (b.calendar(spark, sf).count() - 1)
    sets = scores.parent_sets(b.draws(spark, sf), "g", b.G0.rows).groupBy("node", "parents").agg(F.count("*").alias("n"))
    return scores.structural(sets, sigma)


@query("g18_structural_coefficients", f"""WITH {RESIDUAL_SQL}, summed AS (SELECT node AS i, v AS j, sum(s) AS total FROM sets JOIN solved USING (block)
WHERE p < len(block) GROUP BY ALL)
SELECT i::INT AS i, j::INT AS j, round(coalesce(total, 0) / (SELECT count(*) FROM embeddings), 6) AS b0
FROM (SELECT DISTINCT i, j FROM g0) LEFT JOIN summed USING (i, j)""")
def structural_coefficients(spark, sf):
    """Mean structural coefficient per cell over all draws; a cell without its edge counts as 0."""
    found = _structural(spark, sf)
    edges = found.select("node", "n", F.inline(F.arrays_zip(F.col("parents").alias("j"), F.col("coefs").alias("b"))))
    sums = edges.groupBy(F.col("node").alias("i"), "j").agg(F.sum(F.col("n") * F.col("b")).alias("total"))
    total = b.draws(spark, sf).count()
    cells = b.G0.locate(spark.range(b.G0.slice_size).select(F.col("id").alias("cell"))).select("i", "j")
    return rounded(cells.join(sums, ["i", "j"], "left").select("i", "j", (F.coalesce("total", F.lit(0.0)) / total).alias("b0")), 6, "b0")


@query("g18_structural_variances", f"""WITH {RESIDUAL_SQL} SELECT node::INT AS i, round(avg(s), 6) AS eps, round(min(s), 6) AS low, round(max(s), 6) AS high
FROM sets JOIN solved USING (block) WHERE p = len(block) GROUP BY node""")
def structural_variances(spark, sf):
    """Variance that the parents of each node leave, over all draws."""
    found = _structural(spark, sf)
    return rounded(found.groupBy(F.col("node").alias("i")).agg(
        (F.sum(F.col("n") * F.col("variance")) / F.sum("n")).alias("eps"), F.min("variance").alias("low"), F.max("variance").alias("high")),
        6, "eps", "low", "high")
