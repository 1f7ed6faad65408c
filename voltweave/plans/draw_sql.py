"""SQL building blocks for the queries over posterior draws."""

from __future__ import annotations

# One row per cell of every draw: x is the coefficient, g the edge indicator.
DRAWS = """
nk AS (SELECT count(*) // 4 AS n_keep FROM embeddings),
c AS (SELECT vec_id % 4 AS chain, vec_id // 4 AS draw, (vec_id % 4) * n_keep + vec_id // 4 AS pos,
             k - 1 AS cell, embedding[k]::DOUBLE AS x,
             CASE WHEN embedding[k]::DOUBLE > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g
      FROM embeddings CROSS JOIN nk CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS k)),
g0 AS (SELECT *, cell // 8 AS i, cell % 8 AS j FROM c),
phi AS (SELECT *, [1, 2, 3, 7][cell // 16 + 1] AS lag, (cell % 16) // 4 AS i, cell % 4 AS j FROM c),
gam AS (SELECT *, [1, 7][cell // 32 + 1] AS lag, (cell % 32) // 8 AS i, cell % 8 AS j FROM c),
exog AS (SELECT r_regionkey + shift AS j, r_name || '_' || type AS label, r_regionkey AS country_idx,
                r_name AS source_country, type
         FROM region CROSS JOIN (VALUES ('wind', 0), ('solar', 4)) k(type, shift) WHERE r_regionkey < 4)"""


def moments(source: str, keys: str, value: str) -> str:
    """Posterior summary columns per group."""
    return f"""SELECT {keys}, round(avg({value}), 6) AS mean, round(median({value}), 6) AS median,
round(quantile_cont({value}, 0.05), 6) AS ci_low, round(quantile_cont({value}, 0.95), 6) AS ci_high
FROM {source} GROUP BY {keys}"""


def pooled_acf(source: str, value: str, max_lag: str, biased: bool) -> str:
    """Autocorrelations of the pooled series per cell as CTEs stat and rho."""
    scale = "1 / (n * v)" if biased else "1 / ((n - lag) * v)"
    return f"""
stat AS (SELECT cell, avg({value}) AS mu, var_pop({value}) AS v, count(*) AS n FROM {source} GROUP BY cell),
prod AS (SELECT a.cell, b.pos - a.pos AS lag, sum((a.{value} - mu) * (b.{value} - mu)) AS s
         FROM {source} a JOIN {source} b ON a.cell = b.cell AND b.pos > a.pos AND b.pos <= a.pos + {max_lag}
         JOIN stat ON stat.cell = a.cell GROUP BY ALL),
rho AS (SELECT prod.cell, lag, n, CASE WHEN v < 1e-12 THEN 0 ELSE s * {scale} END AS rho
        FROM prod JOIN stat USING (cell))"""


INITIAL_POSITIVE = """
stop AS (SELECT cell, min(CASE WHEN rho <= 0 THEN lag END) AS lag0 FROM rho GROUP BY cell),
possum AS (SELECT rho.cell, n, coalesce(sum(CASE WHEN lag0 IS NULL OR lag < lag0 THEN rho END), 0) AS total
           FROM rho JOIN stop USING (cell) GROUP BY ALL)"""


def own_acf(source: str, keys: list[str], pos: str, value: str, name: str) -> str:
    """Full autocorrelation of each series (all lags), CTEs {name}_stat and {name}_rho."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""
{name}_stat AS (SELECT {k}, avg({value}) AS mu, var_samp({value}) AS vs, var_pop({value}) AS v, count(*) AS n
           FROM {source} GROUP BY {k}),
{name}_rho AS (SELECT {', '.join('a.' + c for c in keys)}, b.{pos} - a.{pos} AS lag, st.n,
           sum((a.{value} - mu) * (b.{value} - mu)) / st.n AS acov,
           sum((a.{value} - mu) * (b.{value} - mu)) / nullif(st.n * st.v, 0) AS rho
           FROM {source} a JOIN {source} b ON {on} AND b.{pos} > a.{pos}
           JOIN {name}_stat st ON {' AND '.join(f'st.{c} = a.{c}' for c in keys)}
           GROUP BY {', '.join('a.' + c for c in keys)}, b.{pos} - a.{pos}, st.n, st.v)"""


def geyer(rho: str, keys: list[str], name: str) -> str:
    """Initial monotone sequence from rows (keys, lag, n, rho): CTE {name}_tau."""
    k = ", ".join(keys)
    return f"""
{name}_pair AS (SELECT {k}, (lag - 1) // 2 AS m, sum(rho) AS p FROM {rho}
           WHERE lag >= 1 AND lag <= 2 * ((n - 2) // 2) GROUP BY ALL),
{name}_run AS (SELECT *, min(p) OVER (PARTITION BY {k} ORDER BY m) AS low FROM {name}_pair),
{name}_tau AS (SELECT {k}, greatest(1 + 2 * coalesce(sum(CASE WHEN low > 0 THEN low END), 0), 1) AS tau
           FROM {name}_run GROUP BY ALL)"""


BETWEEN_WITHIN = """
cm AS (SELECT chain, cell, avg({v}) AS mean, var_samp({v}) AS var, count(*) AS n FROM {src} GROUP BY ALL),
bw AS (SELECT cell, count(*) AS m, max(n) AS n, max(n) * var_samp(mean) AS b, avg(var) AS w FROM cm GROUP BY cell),
mix AS (SELECT *, (n - 1) / n * w + b / n AS var_hat FROM bw)"""


def between_within(source: str, value: str) -> str:
    return BETWEEN_WITHIN.format(src=source, v=value)


MULTICHAIN = """
mrho AS (SELECT o.cell, lag, mix.n, 1 - (w - sum(acov) / m) / nullif(var_hat, 0) AS rho
         FROM o_rho o JOIN mix ON mix.cell = o.cell GROUP BY o.cell, lag, mix.n, w, m, var_hat)"""


def multichain_ess(source: str, value: str) -> str:
    """CTE mess(cell, ess, total) for draws with columns chain, draw, cell."""
    return (
        between_within(source, value) + "," + own_acf(source, ["chain", "cell"], "draw", value, "o") + ","
        + MULTICHAIN + "," + geyer("mrho", ["cell"], "mc") + """,
mess AS (SELECT mix.cell, m * n AS total, CASE WHEN w = 0 THEN m * n ELSE m * n / tau END AS ess
         FROM mix LEFT JOIN mc_tau USING (cell))"""
    )


def geweke(source: str, value: str) -> str:
    """CTE gz(chain, cell, z) with 10 % / 50 % parts."""
    return (
        f"""
part AS (SELECT chain, cell, 'a' AS part, draw AS at, {value} AS v FROM {source} CROSS JOIN nk
         WHERE draw < greatest(floor(n_keep * 0.1), 2)
         UNION ALL SELECT chain, cell, 'b', (draw - (n_keep - greatest(floor(n_keep * 0.5), 2)))::BIGINT, {value}
         FROM {source} CROSS JOIN nk WHERE draw >= n_keep - greatest(floor(n_keep * 0.5), 2)),"""
        + own_acf("part", ["chain", "cell", "part"], "at", "v", "w") + ","
        + geyer("w_rho", ["chain", "cell", "part"], "wt") + """,
wess AS (SELECT chain, cell, part, mu, vs, n, CASE WHEN n < 4 OR v = 0 THEN n ELSE n / tau END AS ess
         FROM w_stat LEFT JOIN wt_tau USING (chain, cell, part)),
gse AS (SELECT chain, cell, max(CASE WHEN part = 'a' THEN mu END) AS ma, max(CASE WHEN part = 'b' THEN mu END) AS mb,
               sqrt(sum(vs / greatest(ess, 1))) AS se FROM wess GROUP BY ALL),
gz AS (SELECT chain, cell, CASE WHEN se = 0 THEN 0 ELSE (ma - mb) / se END AS z FROM gse)"""
    )


EDGES = """
pip AS (SELECT cell, i, j, avg(g) AS pip FROM g0 GROUP BY ALL),
""" + pooled_acf("c", "g", "100", False) + "," + INITIAL_POSITIVE + """,
raw_edge AS (SELECT i, j, i <> j AS admissible, CASE WHEN i <> j THEN pip ELSE 0 END AS edge_prob,
                    CASE WHEN i <> j THEN least(n / (1 + 2 * total), n) END AS n_eff
             FROM pip JOIN possum USING (cell)),
edge AS (SELECT *, CASE WHEN admissible THEN least(greatest(coalesce(
            edge_prob - 1.2815515655446004 * sqrt(edge_prob * (1 - edge_prob) / nullif(n_eff, 0)), 0), 0), 1) ELSE 0 END AS ci_lower
         FROM raw_edge),
picked AS (SELECT *, edge_prob > 0.5 AND admissible AS selected_naive,
                  ci_lower > 0.5 AND admissible AS selected_credible FROM edge)"""

# Present edges of every draw, self-loops kept (a) and dropped (b).
GRAPH = """
a AS (SELECT chain, draw, j AS s, i AS t FROM g0 WHERE g = 1),
b AS (SELECT * FROM a WHERE s <> t),
alldraws AS (SELECT DISTINCT chain, draw FROM c)"""

CENTRALITY = """
col AS (SELECT chain, draw, j, sum(g) AS o FROM g0 GROUP BY ALL),
step AS MATERIALIZED (SELECT g0.chain, g0.draw, g0.i, g0.j, g / CASE WHEN o = 0 THEN 1 ELSE o END AS w
         FROM g0 JOIN col USING (chain, draw, j)),
it AS (SELECT DISTINCT chain, draw, i AS node, (1.0 / 8)::DOUBLE AS x, 0 AS k FROM g0
       UNION ALL
       SELECT it.chain, it.draw, step.i, 0.85 * sum(w * x) + 0.15 / 8, k + 1
       FROM it JOIN step ON step.chain = it.chain AND step.draw = it.draw AND step.j = it.node
       WHERE k < 120 GROUP BY it.chain, it.draw, step.i, k),
eig AS (SELECT chain, draw, node, x FROM it WHERE k = 120)"""


def betweenness_levels() -> str:
    parts = ["l1 AS MATERIALIZED (SELECT chain, draw, s, t, 1.0::DOUBLE AS c, 1 AS d FROM b)",
             "r1 AS MATERIALIZED (SELECT * FROM l1)"]
    for k in range(2, 8):
        parts.append(f"""l{k} AS MATERIALIZED (SELECT l.chain, l.draw, l.s, e.t, sum(l.c) AS c, {k} AS d
  FROM l{k - 1} l JOIN b e ON l.chain = e.chain AND l.draw = e.draw AND l.t = e.s
  WHERE l.s <> e.t AND NOT EXISTS (SELECT 1 FROM r{k - 1} r WHERE r.chain = l.chain AND r.draw = l.draw
                                   AND r.s = l.s AND r.t = e.t) GROUP BY l.chain, l.draw, l.s, e.t)""")
        parts.append(f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT * FROM l{k})")
    parts.append("""bt AS (SELECT x.chain, x.draw, x.t AS node, sum(x.c * y.c / z.c) / 42 AS v
  FROM r7 x JOIN r7 y ON x.chain = y.chain AND x.draw = y.draw AND x.t = y.s
  JOIN r7 z ON z.chain = x.chain AND z.draw = x.draw AND z.s = x.s AND z.t = y.t
  WHERE x.d + y.d = z.d GROUP BY ALL)""")
    parts.append("""between AS (SELECT chain, draw, node, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT chain, draw FROM a) CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS node)
  LEFT JOIN bt USING (chain, draw, node))""")
    return ",\n".join(parts)


SCC = """
reach AS (SELECT chain, draw, s, t FROM b UNION
          SELECT r.chain, r.draw, r.s, b.t FROM reach r JOIN b ON r.chain = b.chain AND r.draw = b.draw AND r.t = b.s),
scc AS (SELECT chain, draw, 8 - count(DISTINCT s) FILTER (least_of < s) AS n_strong_cc FROM (
          SELECT x.chain, x.draw, x.s, min(x.t) AS least_of FROM reach x JOIN reach y
          ON x.chain = y.chain AND x.draw = y.draw AND x.s = y.t AND x.t = y.s GROUP BY ALL)
        GROUP BY chain, draw)"""

TRIADS = """
tri AS (SELECT p.chain, p.draw, count(*) AS closed FROM b p JOIN b q ON p.chain = q.chain AND p.draw = q.draw AND p.t = q.s
        JOIN b r ON r.chain = p.chain AND r.draw = p.draw AND r.s = p.s AND r.t = q.t GROUP BY ALL),
deg AS (SELECT chain, draw, sum(d * (d - 1)) AS pairs FROM (
        SELECT chain, draw, s, count(*) AS d FROM b GROUP BY ALL) GROUP BY ALL),
trans AS (SELECT chain, draw, coalesce(closed / pairs, 0) AS v FROM (SELECT DISTINCT chain, draw FROM a)
          LEFT JOIN tri USING (chain, draw) LEFT JOIN deg USING (chain, draw))"""

DEGREES = """
indeg AS (SELECT chain, draw, i AS node, sum(g) AS v FROM g0 GROUP BY ALL),
outdeg AS (SELECT chain, draw, j AS node, sum(g) AS v FROM g0 GROUP BY ALL),
totdeg AS (SELECT chain, draw, node, indeg.v + outdeg.v AS v FROM indeg JOIN outdeg USING (chain, draw, node)),
dens AS (SELECT chain, draw, sum(g) / 56 AS v FROM g0 GROUP BY ALL),
recip AS (SELECT p.chain, p.draw, sum(p.g * q.g) / nullif(sum(p.g), 0) AS v FROM g0 p JOIN g0 q
          ON p.chain = q.chain AND p.draw = q.draw AND p.i = q.j AND p.j = q.i GROUP BY ALL)"""

# Weights of the masked coefficients: |posterior mean of g * x|, thresholded before summing.
PHI_W = """
pm AS (SELECT lag, i, j, avg(g * x) AS mean FROM phi GROUP BY ALL),
pw AS (SELECT 'lag' || lag AS slice, i, j, CASE WHEN abs(mean) > 0.03 THEN abs(mean) ELSE 0 END AS w FROM pm),
w AS (SELECT slice, i, j, w FROM pw UNION ALL SELECT 'agg', i, j, sum(w) FROM pw GROUP BY i, j)"""

GAMMA_W = """
gm AS (SELECT lag, i, j, avg(g * x) AS mean FROM gam GROUP BY ALL),
bw AS (SELECT i, j, sum(abs(mean)) AS w FROM gm GROUP BY ALL),
net AS (SELECT type AS slice, i, country_idx AS j, sum(w) AS w FROM bw JOIN exog USING (j) GROUP BY ALL),
w AS (SELECT * FROM net UNION ALL SELECT 'combined', i, j, sum(w) FROM net GROUP BY i, j)"""

# Node and graph metrics of every 4 x 4 matrix in w(slice, i, j, w).
NODE_METRICS = """
ins AS (SELECT slice, i AS node, sum(w) AS in_strength FROM w GROUP BY ALL),
outs AS (SELECT slice, j AS node, sum(w) AS out_strength FROM w GROUP BY ALL),
wcol AS (SELECT slice, j, sum(w) AS o FROM w GROUP BY ALL),
wstep AS MATERIALIZED (SELECT slice, i, j, w / CASE WHEN o = 0 THEN 1 ELSE o END AS w FROM w JOIN wcol USING (slice, j)),
wit AS (SELECT DISTINCT slice, i AS node, 0.25::DOUBLE AS x, 0 AS k FROM w
        UNION ALL
        SELECT wit.slice, wstep.i, 0.85 * sum(w * x) + 0.15 / 4, k + 1 FROM wit JOIN wstep
        ON wstep.slice = wit.slice AND wstep.j = wit.node WHERE k < 250 GROUP BY wit.slice, wstep.i, k),
hop AS (SELECT slice, j AS s, i AS t, 1 / w AS len FROM w WHERE w > 0 AND i <> j),
walk AS (SELECT slice, s, t, len AS cost, [s, t] AS via FROM hop
         UNION ALL
         SELECT walk.slice, walk.s, hop.t, cost + len, list_append(via, hop.t) FROM walk JOIN hop
         ON walk.slice = hop.slice AND walk.t = hop.s WHERE NOT list_contains(via, hop.t)),
short AS (SELECT *, count(*) OVER (PARTITION BY slice, s, t) AS ways FROM (
          SELECT *, min(cost) OVER (PARTITION BY slice, s, t) AS low FROM walk) WHERE cost = low),
inner_ AS (SELECT slice, node, sum(1.0 / ways) / 6 AS v FROM (
           SELECT slice, s, t, ways, unnest(via) AS node FROM short) WHERE node <> s AND node <> t GROUP BY ALL),
nm AS (SELECT ins.slice, ins.node, in_strength, out_strength, in_strength + out_strength AS total_strength,
              x AS eigen, CASE WHEN ins.slice IN (SELECT slice FROM hop) THEN coalesce(v, 0) END AS between
       FROM ins JOIN outs USING (slice, node) JOIN (SELECT * FROM wit WHERE k = 250) USING (slice, node)
       LEFT JOIN inner_ USING (slice, node))"""

GRAPH_LEVEL = """
gr AS (SELECT slice, w, row_number() OVER (PARTITION BY slice ORDER BY w) AS r,
              count(*) OVER (PARTITION BY slice) AS n FROM w WHERE i <> j AND w > 0),
gini AS (SELECT slice, CASE WHEN max(n) >= 2 THEN (max(n) + 1 - 2 * sum((n + 1 - r) * w) / sum(w)) / max(n) END AS weight_gini
         FROM gr GROUP BY slice),
gl AS (SELECT slice, sum(w) AS total_weight, avg(CASE WHEN i <> j THEN w END) AS mean_weight_off_diag,
              avg(CASE WHEN i <> j THEN (w > 0)::INT END) AS weight_density FROM w GROUP BY slice)"""
