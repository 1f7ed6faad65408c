"""Queries over the ingest, panel, imputation and network operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltweave import jobs
from voltweave.functions.columns import country_of, day, kind_of, volatility
from voltweave.functions.fixed import AREA_CODES, DROPPED_VARIABLES
from voltweave.operators import impute, ingest, network, panel
from voltweave.plans import assemble, reports
from voltweave.plans import bindings as b
from voltweave.plans.registry import query, rounded
from voltweave.runtime import cut, scratch_path
from voltweave.sources import market, tables
from voltweave.sources.market import FEEDS

EVENTS = """
ev AS (SELECT ts, ts::DATE AS date, 'A' || (user_id % 10) AS area, event_type AS production, value AS mw
       FROM events),
kept AS (SELECT date, area AS country,
                CASE production WHEN 'purchase' THEN 'Buy' ELSE 'Browse' END AS variable, mw
         FROM ev WHERE production IN ('view', 'click', 'purchase') AND area <> 'A9'),
gen AS (SELECT date, country, variable, coalesce(sum(mw), 0) AS value FROM kept GROUP BY ALL),
load AS (SELECT date, area AS country, avg(mw) AS value FROM ev WHERE area <> 'A9' GROUP BY ALL)"""

PRICES = """
zone AS (SELECT n_nationkey, n_name AS zone, r_name AS country
         FROM nation JOIN region ON n_regionkey = r_regionkey),
price_rows AS (SELECT o_orderdate::DATE AS date, country, zone, o_totalprice AS price
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN zone ON c_nationkey = n_nationkey),
price AS (SELECT date, country, sum(z::DECIMAL(28, 8))::DOUBLE / count(z) AS value
          FROM (SELECT date, country, zone, sum(price::DECIMAL(28, 8))::DOUBLE / count(price) AS z FROM price_rows GROUP BY ALL)
          GROUP BY ALL)"""

RESERVE = PRICES + """,
gf AS (SELECT l_shipdate::DATE AS date, country, sum(l_extendedprice * (1 - l_discount)) AS value
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN zone ON s_nationkey = n_nationkey GROUP BY ALL),
lf AS (SELECT date, country, sum(price) AS value FROM price_rows GROUP BY ALL),
rm AS (SELECT date, country, (gf.value - lf.value) / nullif(lf.value, 0) AS value
       FROM gf JOIN lf USING (date, country))"""

TRANSFERS = """
raw AS (SELECT o_orderdate AS datetime, s_nationkey AS from_code, c_nationkey AS to_code,
               sn.n_name AS from_map, cn.n_name AS to_map, l_quantity AS capacity_mw,
               l_returnflag AS contract_type, l_linestatus AS resolution,
               l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
        JOIN nation cn ON c_nationkey = cn.n_nationkey),
coded AS (SELECT * REPLACE (
            CASE WHEN from_map LIKE 'NATION\\_2%' ESCAPE '\\' THEN 'NATION_2' ELSE from_map END AS from_map,
            CASE WHEN to_map LIKE 'NATION\\_2%' ESCAPE '\\' THEN 'NATION_2' ELSE to_map END AS to_map) FROM raw),
firsts AS (SELECT * FROM coded QUALIFY row_number() OVER (
             PARTITION BY datetime, from_code, to_code, contract_type
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, from_map, to_map, capacity_mw, resolution) = 1),
clean AS (SELECT * FROM firsts WHERE capacity_mw > 0),
inside AS (SELECT * FROM clean WHERE from_map NOT IN ('NATION_7', 'NATION_8')
                                 AND to_map NOT IN ('NATION_7', 'NATION_8')),
edges AS (SELECT from_map AS src, to_map AS dst, avg(capacity_mw) AS capacity_mw FROM inside GROUP BY ALL)"""

NETWORK_NODES = [f"NATION_{k}" for k in range(25) if k not in (7, 8)]

GAPS = """
buys AS (SELECT ts::DATE AS date, user_id || '-' || event_type AS series, avg(value) AS value
         FROM events GROUP BY ALL),
days AS (SELECT DISTINCT ts::DATE AS date FROM events),
grid AS (SELECT series, date, value FROM (SELECT DISTINCT series FROM buys) CROSS JOIN days
         LEFT JOIN buys USING (series, date)),
ff AS (SELECT series, date, last_value(value IGNORE NULLS) OVER (
         PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM grid)"""


def gap_cte(source: str, name: str) -> str:
    return f"""
{name}_flag AS (SELECT *, CASE WHEN (value IS NULL) <> lag(value IS NULL) OVER (PARTITION BY series ORDER BY date)
                 THEN 1 ELSE 0 END AS flag FROM {source}),
{name}_run AS (SELECT *, sum(flag) OVER (PARTITION BY series ORDER BY date) AS run FROM {name}_flag),
{name} AS (SELECT series, date, value, run, CASE WHEN value IS NULL
             THEN count(*) OVER (PARTITION BY series, run) ELSE 0 END AS gap FROM {name}_run)"""


def seasonal_cte(source: str, name: str) -> str:
    return gap_cte(source, f"{name}_g") + f""",
{name}_med AS (SELECT series, isodow(date) AS dow, median(value) AS season FROM {name}_g GROUP BY ALL),
{name}_res AS (SELECT g.*, season, value - season AS r,
               row_number() OVER (PARTITION BY g.series ORDER BY date) AS rn
        FROM {name}_g g LEFT JOIN {name}_med med ON g.series = med.series AND isodow(g.date) = med.dow),
{name}_spots AS (SELECT *,
  last_value(CASE WHEN r IS NOT NULL THEN date END IGNORE NULLS) OVER p AS d0,
  last_value(r IGNORE NULLS) OVER p AS r0,
  last_value(CASE WHEN r IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS n0,
  first_value(CASE WHEN r IS NOT NULL THEN date END IGNORE NULLS) OVER f AS d1,
  first_value(r IGNORE NULLS) OVER f AS r1
  FROM {name}_res WINDOW p AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  f AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT series, date, CASE WHEN gap BETWEEN 1 AND 16 THEN
    CASE WHEN rn - n0 <= 16 THEN season + CASE WHEN d1 IS NULL THEN r0
         WHEN d1 = d0 THEN r0 ELSE r0 + (r1 - r0) * (date - d0) / (d1 - d0) END END
    ELSE value END AS value FROM {name}_spots)"""


SEASONAL = GAPS + "," + seasonal_cte("ff", "filled")


def spline_cte(source: str, name: str) -> str:
    """Not-a-knot spline through the known days for gaps of up to 7; the tridiagonal sweep runs as two recursions."""
    return gap_cte(source, f"{name}_g") + f""",
{name}_k AS (SELECT series, date, date - DATE '1970-01-01' AS x, value AS y,
  row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM {source} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY date)),
{name}_h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS slope
  FROM {name}_k WHERE n >= 4 WINDOW w AS (PARTITION BY series ORDER BY k)),
{name}_w AS (SELECT *, lag(h) OVER w AS h0, lag(slope) OVER w AS slope0, lead(h) OVER w AS h2, lag(h, 2) OVER w AS hb
  FROM {name}_h WINDOW w AS (PARTITION BY series ORDER BY k)),
{name}_c AS (SELECT series, k, n,
  h0 - CASE WHEN k = n - 2 THEN h * h / h0 ELSE 0 END AS low,
  2.0 * (h0 + h) + CASE WHEN k = 1 THEN h0 * (1 + h0 / h) ELSE 0 END + CASE WHEN k = n - 2 THEN h * (1 + h / h0) ELSE 0 END AS diag,
  h - CASE WHEN k = 1 THEN h0 * h0 / h ELSE 0 END AS up, 6.0 * (slope - slope0) AS rhs
  FROM {name}_w WHERE k BETWEEN 1 AND n - 2),
{name}_f AS (SELECT series, k, n, up, diag::DOUBLE AS dg, rhs::DOUBLE AS rh FROM {name}_c WHERE k = 1
  UNION ALL SELECT c.series, c.k, c.n, c.up, c.diag - c.low / f.dg * f.up, c.rhs - c.low / f.dg * f.rh
  FROM {name}_f f JOIN {name}_c c ON c.series = f.series AND c.k = f.k + 1),
{name}_b AS (SELECT series, k, n, rh / dg AS m FROM {name}_f WHERE k = n - 2
  UNION ALL SELECT f.series, f.k, f.n, (f.rh - f.up * b.m) / f.dg FROM {name}_b b JOIN {name}_f f ON f.series = b.series AND f.k = b.k - 1),
{name}_e AS (SELECT a.series, a.k, a.m, a.n, w.h0 / w.h AS r, w.h / w.h0 AS s FROM {name}_b a JOIN {name}_w w USING (series, k)),
{name}_m AS (SELECT series, k, m FROM {name}_e
  UNION ALL SELECT a.series, 0, (1 + a.r) * a.m - a.r * b.m FROM {name}_e a JOIN {name}_e b ON b.series = a.series AND b.k = 2 WHERE a.k = 1
  UNION ALL SELECT a.series, a.n - 1, (1 + a.s) * a.m - a.s * b.m FROM {name}_e a JOIN {name}_e b ON b.series = a.series AND b.k = a.n - 3 WHERE a.k = a.n - 2),
{name}_at AS (SELECT g.series, g.date, g.value, g.gap, g.date - DATE '1970-01-01' AS at,
  last_value(k.k IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.date) AS k FROM {name}_g g LEFT JOIN {name}_k k ON k.series = g.series AND k.date = g.date),
{name} AS (SELECT p.series, p.date, CASE WHEN p.gap BETWEEN 1 AND 7 THEN
  (a.m * (r.x - p.at) ** 3 + b.m * (p.at - l.x) ** 3) / (6.0 * l.h) + (l.y / l.h - a.m * l.h / 6.0) * (r.x - p.at) + (r.y / l.h - b.m * l.h / 6.0) * (p.at - l.x)
  ELSE p.value END AS value
  FROM {name}_at p LEFT JOIN {name}_h l ON l.series = p.series AND l.k = p.k LEFT JOIN {name}_h r ON r.series = p.series AND r.k = p.k + 1
  LEFT JOIN {name}_m a ON a.series = p.series AND a.k = p.k LEFT JOIN {name}_m b ON b.series = p.series AND b.k = p.k + 1)"""


PANEL = """
panel AS (SELECT ts::DATE AS date, 'A' || (user_id % 10) AS series, sum(value) AS value FROM events GROUP BY ALL)"""


# ---- scans, projections and filters -----------------------------------------------------------


@query("s1_generation_scan", "SELECT ts, 'A' || (user_id % 10) AS area, event_type AS production, value AS mw FROM events")
def generation_scan(spark, sf):
    return b.readings(spark, sf)


@query("s8_panel_scan_sorted", f"""WITH {EVENTS}
SELECT date, sum(CASE WHEN country = 'A0' THEN value END) AS "A0_Load",
       sum(CASE WHEN country = 'A3' THEN value END) AS "A3_Load"
FROM (SELECT date, country, round(value, 6) AS value FROM load) GROUP BY date""")
def panel_scan(spark, sf):
    """Daily pivot written as CSV, then scanned by date column with two of its columns."""
    daily = rounded(ingest.load_daily(b.readings(spark, sf), b.AREAS), 6, "value")
    wide = ingest.pivot_daily(ingest.labelled(daily, "Load"), "mean", columns=[f"{a}_Load" for a in b.AREAS])
    path = scratch_path(spark, "panel")
    tables.write_panel_csv(wide, path)
    return tables.read_panel_csv(spark, path).select("date", "A0_Load", "A3_Load")


@query("s10_matrix_csv_scan", f"""WITH {TRANSFERS},
nodes AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges)
SELECT a.n AS src, c.n AS dst, coalesce(round(capacity_mw, 6), 0) AS value
FROM nodes a CROSS JOIN nodes c LEFT JOIN edges ON src = a.n AND dst = c.n""")
def matrix_scan(spark, sf):
    """Dense capacity matrix written as a labelled CSV and read back as edges."""
    edges = cut(rounded(network.capacity_edges(_inside(spark, sf)), 6, "capacity_mw"))
    nodes = network.node_list(edges)
    path = scratch_path(spark, "matrix")
    tables.write_matrix_csv(network.dense_matrix(edges, nodes), "capacity_mw", path)
    return tables.read_matrix_csv(spark, path)


@query("p1_generation_filter", f"WITH {EVENTS} SELECT * FROM kept")
def generation_filter(spark, sf):
    return ingest.generation_rows(b.readings(spark, sf), b.AREAS, b.PRODUCTION)


@query("p3_zone_country_map", f"WITH {PRICES} SELECT * FROM price_rows")
def zone_country_map(spark, sf):
    return ingest.price_rows(b.prices(spark, sf), b.zones(spark, sf))


@query("p4_endpoint_filter", f"""WITH {TRANSFERS}
SELECT from_map, to_map, count(*) AS n, sum(capacity_mw) AS capacity_mw FROM inside GROUP BY ALL""")
def endpoint_filter(spark, sf):
    return _inside(spark, sf).groupBy("from_map", "to_map").agg(
        F.count("*").alias("n"), F.sum("capacity_mw").alias("capacity_mw"))


@query("p4_excluded_codes", f"""WITH {TRANSFERS}
SELECT from_map AS code FROM clean WHERE from_map IN ('NATION_7', 'NATION_8')
UNION SELECT to_map FROM clean WHERE to_map IN ('NATION_7', 'NATION_8')""")
def excluded_codes(spark, sf):
    return network.excluded_codes(_clean(spark, sf), NETWORK_NODES)


@query("p6_prefix_codes", """SELECT CASE WHEN starts_with(n_name, 'NATION_2') THEN 'NATION_2' ELSE n_name END AS code,
count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def prefix_codes(spark, sf):
    named = b.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("_n")).join(
        b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy(network.merged_code("n_name", "NATION_2", "NATION_2").alias("code")).agg(
        F.sum("_n").alias("n"))


@query("p7_positive_values", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY ALL")
def positive_values(spark, sf):
    return rounded(b.table(spark, sf, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.sum("c_acctbal").alias("total")), 2, "total")


@query("p9_day_truncation", "SELECT ts::DATE AS date, isodow(ts)::INT - 1 AS weekday, date_trunc('month', ts)::DATE AS month, count(*) AS n FROM events GROUP BY ALL")
def day_truncation(spark, sf):
    ev = b.table(spark, sf, "events")
    return ev.groupBy(day("ts").alias("date"), F.weekday("ts").alias("weekday"),
                      F.trunc("ts", "MM").alias("month")).agg(F.count("*").alias("n"))


@query("p10_column_key", f"""WITH {EVENTS} SELECT country || '_' || variable AS "column", count(*) AS days FROM gen GROUP BY ALL""")
def column_key(spark, sf):
    return ingest.labelled(_generation(spark, sf)).groupBy("column").agg(F.count("*").alias("days"))


@query("p11_extract_columns", f"""WITH {EVENTS}
SELECT date, round(sum(CASE WHEN country = 'A1' AND variable = 'Buy' THEN value ELSE 0 END), 4) AS "A1_Buy",
       round(sum(CASE WHEN country = 'A4' AND variable = 'Buy' THEN value ELSE 0 END), 4) AS "A4_Buy"
FROM gen GROUP BY date""")
def extract_columns(spark, sf):
    wide = ingest.pivot_daily(ingest.labelled(_generation(spark, sf)), "sum", fill=0.0)
    found, _ = panel.wanted_columns(wide.columns, ["A1", "ZZ", "A4"], "Buy")
    return rounded(wide.select("date", *found), 4, *found)


_COUNTRY_SETS = f"""WITH {RESERVE},
has_price AS (SELECT country FROM price GROUP BY country HAVING avg(value) > 248000),
has_load AS (SELECT country FROM lf GROUP BY country HAVING avg(value) < 430000)"""


def _country_sets(spark, sf):
    price = _price(spark, sf).groupBy("country").agg(F.avg("value").alias("v")).where("v > 248000")
    load = _load_forecast(spark, sf).groupBy("country").agg(F.avg("value").alias("v")).where("v < 430000")
    return b.regions(spark, sf), price, load


@query("p12_included_countries", _COUNTRY_SETS + """
SELECT r_regionkey AS idx, r_name AS country FROM region
WHERE r_name IN (SELECT country FROM has_price) AND r_name IN (SELECT country FROM has_load)""")
def included_countries(spark, sf):
    return panel.included_countries(*_country_sets(spark, sf))


@query("p12_excluded_countries", _COUNTRY_SETS + """
SELECT r_name AS country, concat_ws(', ', CASE WHEN p.country IS NULL THEN 'Price' END,
                                    CASE WHEN l.country IS NULL THEN 'Load' END) AS missing
FROM region LEFT JOIN has_price p ON r_name = p.country LEFT JOIN has_load l ON r_name = l.country
WHERE p.country IS NULL OR l.country IS NULL""")
def excluded_countries(spark, sf):
    return panel.excluded_countries(*_country_sets(spark, sf))


@query("p13_interleaved_columns", f"""WITH {RESERVE}, both_ AS (
SELECT country, 'Price' AS variable, count(*) AS n FROM price GROUP BY ALL
UNION ALL SELECT country, 'Load', count(*) FROM lf GROUP BY ALL)
SELECT (r_regionkey * 2 + CASE variable WHEN 'Price' THEN 0 ELSE 1 END)::INT AS position,
       country || '_' || variable AS "column", n FROM both_ JOIN region ON r_name = country""")
def interleaved_columns(spark, sf):
    rows = _endogenous(spark, sf).groupBy("country", "variable").agg(F.count("*").alias("n"))
    out = panel.interleaved(rows, b.regions(spark, sf), ["Price", "Load"])
    return ingest.labelled(out).select("position", "column", "n")


@query("p14_dropped_columns", f"""WITH {EVENTS} SELECT country, variable, count(*) AS n FROM gen
WHERE country || '_' || variable NOT IN ('A2_Buy', 'A5_Browse') GROUP BY ALL""")
def dropped_columns(spark, sf):
    return panel.drop_columns(_generation(spark, sf), ["A2_Buy", "A5_Browse"]).groupBy(
        "country", "variable").agg(F.count("*").alias("n"))


@query("p15_endogenous_mode", f"""WITH {RESERVE} SELECT country || '_Price' AS "column", date, value FROM price""")
def endogenous_mode(spark, sf):
    rows = panel.endogenous(ingest.labelled(_endogenous(spark, sf)), "prices_only")
    return rows.select("column", "date", "value")


@query("p16_exogenous_selection", f"""WITH {EVENTS}
SELECT CASE variable WHEN 'Buy' THEN 0 ELSE 1 END AS block, country || '_' || variable AS "column", count(*) AS n
FROM gen GROUP BY ALL""")
def exogenous_selection(spark, sf):
    rows = panel.exogenous(ingest.labelled(_generation(spark, sf)), ["buy", "browse"])
    return rows.groupBy("block", "column").agg(F.count("*").alias("n"))


@query("p20_name_parse", f"""WITH {EVENTS} SELECT DISTINCT country AS cc, variable AS kind FROM gen""")
def name_parse(spark, sf):
    names = ingest.labelled(_generation(spark, sf)).select("column").distinct()
    return names.select(country_of(F.col("column")).alias("cc"), kind_of(F.col("column")).alias("kind"))


# ---- aggregations -------------------------------------------------------------------------------


def _generation(spark, sf):
    return ingest.generation_daily(b.readings(spark, sf), b.AREAS, b.PRODUCTION)


def _price(spark, sf):
    return ingest.price_daily(b.zone_prices(spark, sf).withColumn("date", day("ts")))


def _load_forecast(spark, sf):
    return ingest.forecast_daily(b.load_forecast(spark, sf), b.region_names())


def _generation_forecast(spark, sf):
    return ingest.forecast_daily(b.generation_forecast(spark, sf), b.region_names())


def _reserve(spark, sf):
    return ingest.reserve_margin(_generation_forecast(spark, sf), _load_forecast(spark, sf))


def _endogenous(spark, sf):
    price = _price(spark, sf).withColumn("variable", F.lit("Price"))
    return price.unionByName(_load_forecast(spark, sf).withColumn("variable", F.lit("Load")))


@query("a1_generation_daily", f"WITH {EVENTS} SELECT date, country, variable, round(value, 4) AS value FROM gen")
def generation_daily(spark, sf):
    return rounded(_generation(spark, sf), 4, "value")


@query("a2_load_daily_mean", f"WITH {EVENTS} SELECT date, country, round(value, 6) AS value FROM load")
def load_daily(spark, sf):
    return rounded(ingest.load_daily(b.readings(spark, sf), b.AREAS), 6, "value")


@query("a3_price_daily", f"WITH {PRICES} SELECT date, country, value FROM price")
def price_daily(spark, sf):
    return _price(spark, sf)


@query("a4_generation_forecast_daily", f"WITH {RESERVE} SELECT date, country, round(value, 4) AS value FROM gf")
def generation_forecast_daily(spark, sf):
    return rounded(_generation_forecast(spark, sf), 4, "value")


@query("a4_load_forecast_daily", f"WITH {RESERVE} SELECT date, country, round(value, 2) AS value FROM lf")
def load_forecast_daily(spark, sf):
    return rounded(_load_forecast(spark, sf), 2, "value")


def _pivot_sql(source: str, columns: list[tuple[str, str]], digits: int | None, fill: bool) -> str:
    parts = []
    for label, cond in columns:
        value = f"sum(CASE WHEN {cond} THEN value END)"
        value = f"coalesce({value}, 0)" if fill else value
        parts.append(f'{value if digits is None else f"round({value}, {digits})"} AS "{label}"')
    return f"SELECT date, {', '.join(parts)} FROM {source} GROUP BY date"


_GEN_COLUMNS = [(f"{a}_{v}", f"country = '{a}' AND variable = '{v}'") for a in b.AREAS for v in ("Browse", "Buy")]


@query("a5_generation_pivot", f"WITH {EVENTS} " + _pivot_sql("gen", _GEN_COLUMNS, 4, True))
def generation_pivot(spark, sf):
    labels = [c for c, _ in _GEN_COLUMNS]
    wide = ingest.pivot_daily(ingest.labelled(_generation(spark, sf)), "sum", 0.0, labels)
    return rounded(wide, 4, *labels)


@query("a6_load_pivot", f"WITH {EVENTS} " + _pivot_sql(
    "load", [(f"{a}_Load", f"country = '{a}'") for a in b.AREAS], 6, True))
def load_pivot(spark, sf):
    labels = [f"{a}_Load" for a in b.AREAS]
    daily = ingest.load_daily(b.readings(spark, sf), b.AREAS)
    return rounded(ingest.pivot_daily(ingest.labelled(daily, "Load"), "mean", 0.0, labels), 6, *labels)


@query("a7_price_pivot", f"WITH {PRICES} " + _pivot_sql(
    "price", [(f"{r}_Price", f"country = '{r}'") for r in b.region_names()], None, False))
def price_pivot(spark, sf):
    labels = [f"{r}_Price" for r in b.region_names()]
    return ingest.pivot_daily(ingest.labelled(_price(spark, sf), "Price"), "mean", None, labels)


@query("a8_reserve_margin_pivot", f"WITH {RESERVE} " + _pivot_sql(
    "rm", [(f"{r}_RM", f"country = '{r}'") for r in b.region_names()], 6, False))
def reserve_pivot(spark, sf):
    labels = [f"{r}_RM" for r in b.region_names()]
    return rounded(ingest.pivot_daily(ingest.labelled(_reserve(spark, sf), "RM"), "mean", None, labels), 6, *labels)


@query("j1_reserve_join", f"WITH {RESERVE} SELECT date, country, round(value, 6) AS value FROM rm")
def reserve_join(spark, sf):
    return rounded(_reserve(spark, sf).select("date", "country", "value"), 6, "value")


# ---- network ------------------------------------------------------------------------------------


def _clean(spark, sf):
    """Records are deduplicated by their codes, in as many tasks as their number asks for; names are joined to those that are
    left."""
    rows = network.first_per_key(b.transfer_codes(spark, sf), network.DEDUPE_KEYS, b.CAPACITY_ORDER)
    first = cut(rows.where(F.col("capacity_mw") > 0), b.transfer_tasks(spark, sf))
    named = b.with_names(spark, sf, first)
    return network.normalise_codes(named, "NATION_2", "NATION_2")


def _inside(spark, sf):
    return network.within(_clean(spark, sf), NETWORK_NODES)


@query("j16_first_per_key", f"""WITH {TRANSFERS} SELECT datetime, from_code, to_code, contract_type, from_map, to_map,
capacity_mw, resolution, l_orderkey, l_linenumber FROM clean""")
def first_per_key(spark, sf):
    return _clean(spark, sf).select(
        "datetime", "from_code", "to_code", "contract_type", "from_map", "to_map", "capacity_mw",
        "resolution", "l_orderkey", "l_linenumber")


for _how, _agg in (("mean", "avg"), ("max", "max"), ("median", "median")):
    @query(f"a9_capacity_{_how}", f"""WITH {TRANSFERS} SELECT from_map AS src, to_map AS dst,
    round({_agg}(capacity_mw), 6) AS capacity_mw FROM inside GROUP BY ALL""")
    def capacity(spark, sf, how=_how):
        return rounded(network.capacity_edges(_inside(spark, sf), how), 6, "capacity_mw")


@query("a10_monthly_counts", f"WITH {TRANSFERS} SELECT date_trunc('month', datetime)::DATE AS month, count(*) AS n FROM inside GROUP BY ALL")
def monthly_counts(spark, sf):
    return network.monthly_counts(_inside(spark, sf))


@query("j7_node_universe", f"""WITH {TRANSFERS} SELECT (row_number() OVER (ORDER BY node) - 1)::INT AS idx, node
FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)""")
def node_universe(spark, sf):
    return network.node_list(network.capacity_edges(_inside(spark, sf)))


@query("j8_code_difference", """SELECT n_name AS code FROM nation EXCEPT SELECT n_name FROM nation
JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000""")
def code_difference(spark, sf):
    nations = b.table(spark, sf, "nation")
    rich = b.table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return nations.select(F.col("n_name").alias("code")).subtract(
        nations.join(rich, "n_nationkey", "left_semi").select("n_name"))


_DENSE = f"""WITH {TRANSFERS}, nodes AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges),
dense AS (SELECT a.n AS src, c.n AS dst, coalesce(capacity_mw, 0) AS capacity_mw
          FROM nodes a CROSS JOIN nodes c LEFT JOIN edges ON src = a.n AND dst = c.n),
g0 AS (SELECT src, dst, capacity_mw, CASE WHEN capacity_mw >= 25.5 AND src <> dst THEN 1 ELSE 0 END AS g0 FROM dense)"""


def _matrix(spark, sf):
    # A row for each pair of nodes, read for the matrix and for its nodes.
    edges = cut(network.capacity_edges(_inside(spark, sf)))
    return network.dense_matrix(edges, network.node_list(edges))


@query("j9_dense_matrix", _DENSE + " SELECT src, dst, round(capacity_mw, 6) AS capacity_mw FROM dense")
def dense_matrix(spark, sf):
    return rounded(_matrix(spark, sf), 6, "capacity_mw")


@query("f9_binarise", _DENSE + " SELECT src, dst, g0 FROM g0")
def binarise(spark, sf):
    return network.binarise(_matrix(spark, sf), 25.5).select("src", "dst", "g0")


def _final_countries(spark, sf):
    return b.table(spark, sf, "nation").where("n_name IN ('NATION_11', 'NATION_3', 'NATION_5', 'NATION_9')").select(
        (F.col("n_nationkey") % 3).alias("_k"), F.col("n_name").alias("country")).selectExpr(
        "CASE country WHEN 'NATION_11' THEN 0 WHEN 'NATION_3' THEN 1 WHEN 'NATION_5' THEN 2 ELSE 3 END AS idx", "country")


_FINAL = _DENSE + """, final AS (SELECT * FROM (VALUES (0, 'NATION_11'), (1, 'NATION_3'), (2, 'NATION_5'),
(3, 'NATION_9')) v(idx, country))"""


@query("p17_submatrix", _FINAL + """ SELECT a.idx::INT AS i, c.idx::INT AS j, src, dst, g0
FROM g0 JOIN final a ON src = a.country JOIN final c ON dst = c.country""")
def submatrix(spark, sf):
    matrix, final = network.binarise(_matrix(spark, sf), 25.5), _final_countries(spark, sf)
    return network.submatrix(matrix, final).select("i", "j", "src", "dst", "g0")


@query("p17_dropped_nodes", _FINAL + " SELECT DISTINCT src AS country FROM g0 WHERE src NOT IN (SELECT country FROM final)")
def dropped_nodes(spark, sf):
    return network.dropped_nodes(_matrix(spark, sf), _final_countries(spark, sf)).select("country")


@query("g11_expanded_mask", _FINAL + """, m AS (SELECT a.idx AS i, c.idx AS j, g0 FROM g0
JOIN final a ON src = a.country JOIN final c ON dst = c.country),
v AS (SELECT unnest([0, 1]) AS k)
SELECT (i * 2 + a.k)::INT AS i, (j * 2 + c.k)::INT AS j FROM m, v a, v c
WHERE (g0 = 1 OR i = j) AND i * 2 + a.k <> j * 2 + c.k""")
def expanded_mask(spark, sf):
    matrix, final = network.binarise(_matrix(spark, sf), 25.5), _final_countries(spark, sf)
    return network.expand_mask(network.submatrix(matrix, final), 4, 2)


@query("k4_filtered_network", _FINAL + """ SELECT src, dst, g0::DOUBLE AS value FROM g0 JOIN final a ON src = a.country
JOIN final c ON dst = c.country""")
def filtered_network(spark, sf):
    """Matrix and country list written, filtered, written in list order and read again."""
    path = scratch_path(spark, "filtered")
    tables.write_matrix_csv(network.binarise(_matrix(spark, sf), 25.5), "g0", f"{path}/matrix")
    tables.write_countries(_final_countries(spark, sf), f"{path}/countries")
    matrix, countries = tables.read_matrix_csv(spark, f"{path}/matrix"), tables.read_countries(spark, f"{path}/countries")
    network.check_countries(matrix, countries)
    tables.write_matrix_csv(network.submatrix(matrix, countries), "value", f"{path}/filtered", ("i", "j"))
    return tables.read_matrix_csv(spark, f"{path}/filtered")


@query("k6_report_folder", f"""WITH {TRANSFERS} SELECT 'nodes' AS sheet, node AS label, NULL::DOUBLE AS value
FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
UNION ALL SELECT 'months', date_trunc('month', datetime)::DATE::VARCHAR, count(*)::DOUBLE FROM inside GROUP BY ALL""")
def report_folder(spark, sf):
    """Report tables written as one folder and read again."""
    path = scratch_path(spark, "report")
    # Both sheets read it; the joins and the deduplication behind it run only once, for the table that it comes from.
    inside = _inside(spark, sf)
    reports.write_sheets({
        "nodes": network.node_list(network.capacity_edges(inside)).select(F.col("node").alias("label"), F.lit(None).cast("double").alias("value")),
        "months": network.monthly_counts(inside).select(F.col("month").cast("string").alias("label"), F.col("n").cast("double").alias("value")),
    }, path)
    sheets = [
        spark.read.schema("label string, value double").option("header", True).csv(f"{path}/{name}").withColumn("sheet", F.lit(name))
        for name in ("nodes", "months")]
    return sheets[0].unionByName(sheets[1])


# ---- panel --------------------------------------------------------------------------------------


@query("j2_common_calendar", f"""WITH {RESERVE} SELECT DISTINCT date FROM price WHERE date IN (SELECT date FROM gf)
AND date IN (SELECT date FROM lf) AND date IN (SELECT date FROM rm WHERE value > -0.4)""")
def common_calendar(spark, sf):
    return panel.common_calendar([
        _price(spark, sf), _generation_forecast(spark, sf), _load_forecast(spark, sf),
        _reserve(spark, sf).where("value > -0.4")])


@query("j3_reindexed_panel", f"""WITH {RESERVE}, cal AS (SELECT DISTINCT date FROM gf)
SELECT c.country, cal.date, price.value
FROM (SELECT DISTINCT country FROM price) c CROSS JOIN cal LEFT JOIN price USING (country, date)""")
def reindexed_panel(spark, sf):
    calendar = _generation_forecast(spark, sf).select("date").distinct()
    return panel.on_calendar(_price(spark, sf), calendar)


@query("j4_stacked_panel", f"""WITH {RESERVE} SELECT variable, count(*) AS n, round(avg(value), 4) AS mean FROM (
SELECT 'Price' AS variable, value FROM price UNION ALL SELECT 'Load', value FROM lf) GROUP BY ALL""")
def stacked_panel(spark, sf):
    return rounded(_endogenous(spark, sf).groupBy("variable").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean")), 4, "mean")


@query("j4_aligned_panel", f"WITH {RESERVE} SELECT p.*, l.* EXCLUDE (date) FROM (" + _pivot_sql(
    "price", [(f"{r}_Price", f"country = '{r}'") for r in b.region_names()], None, False) + ") p JOIN (" + _pivot_sql(
    "lf", [(f"{r}_Load", f"country = '{r}'") for r in b.region_names()], 2, False) + ") l USING (date)")
def aligned_panel(spark, sf):
    """Wide frames side by side, one row per common date."""
    prices, loads = [f"{r}_Price" for r in b.region_names()], [f"{r}_Load" for r in b.region_names()]
    wide = ingest.pivot_daily(ingest.labelled(_price(spark, sf), "Price"), "mean", None, prices)
    load = ingest.pivot_daily(ingest.labelled(_load_forecast(spark, sf), "Load"), "mean", None, loads)
    return wide.join(rounded(load, 2, *loads), "date")


@query("j5_union_all", f"""WITH {EVENTS} SELECT production, count(*) AS n, round(sum(mw), 2) AS mw FROM (
SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE production = 'error') GROUP BY ALL""")
def union_all(spark, sf):
    rows = b.readings(spark, sf)
    both = rows.unionByName(rows.where("production = 'error'"))
    return rounded(both.groupBy("production").agg(F.count("*").alias("n"), F.sum("mw").alias("mw")), 2, "mw")


@query("a12_moments", f"""WITH {EVENTS} SELECT country, variable, round(avg(value), 6) AS mean,
round(stddev_samp(value), 6) AS std, round(min(value), 4) AS low, round(max(value), 4) AS high FROM gen GROUP BY ALL""")
def moments(spark, sf):
    stats = panel.moments(_generation(spark, sf), ["country", "variable"])
    return rounded(rounded(stats, 6, "mean", "std"), 4, "low", "high")


@query("f4_standardised", f"""WITH {EVENTS}, m AS (SELECT country, variable, avg(value) AS mean,
stddev_samp(value) AS sd FROM gen GROUP BY ALL)
SELECT date, country, variable, round((value - mean) / CASE WHEN sd < 1e-10 THEN 1 ELSE sd END, 6) AS z
FROM gen JOIN m USING (country, variable)""")
def standardised(spark, sf):
    z = panel.standardise(_generation(spark, sf), ["country", "variable"], strict=False)
    return rounded(z.select("date", "country", "variable", "z"), 6, "z")


@query("w5_lag_design", f"""WITH {PANEL} SELECT date, series, round(value, 4) AS value, round(lag1, 4) AS lag1,
round(lag7, 4) AS lag7 FROM (SELECT *, lag(value, 1) OVER w AS lag1, lag(value, 7) OVER w AS lag7,
row_number() OVER w AS t FROM panel WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE t > 7""")
def lag_design(spark, sf):
    return rounded(panel.lag_design(b.daily_by_area(spark, sf), ["series"], [1, 7]), 4, "value", "lag1", "lag7")


@query("w6_first_difference", f"""WITH {PANEL}, d AS (SELECT series, date,
value - lag(value) OVER (PARTITION BY series ORDER BY date) AS eta FROM panel)
SELECT series, date, round(eta, 4) AS eta FROM d WHERE eta IS NOT NULL""")
def first_difference(spark, sf):
    return rounded(panel.first_difference(b.daily_by_area(spark, sf), ["series"]).select(
        "series", "date", "eta"), 4, "eta")


@query("a39_ar1_variance", f"""WITH {PANEL}, p AS (SELECT series, value AS y, lag(value) OVER w AS x,
row_number() OVER w AS t FROM panel WINDOW w AS (PARTITION BY series ORDER BY date)),
fit AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE t > 7 GROUP BY series)
SELECT series, round(var_pop(y - a - b * x), 4) AS sigma2 FROM p JOIN fit USING (series) WHERE t > 7 GROUP BY series""")
def ar1_variance(spark, sf):
    return rounded(panel.ar1_residual_variance(b.daily_by_area(spark, sf), ["series"], 7), 4, "sigma2")


# ---- imputation ---------------------------------------------------------------------------------


def _grid(spark, sf):
    return panel.on_calendar(b.spread_gaps(spark, sf), b.calendar(spark, sf)).select("series", "date", "value")


@query("w1_forward_fill", f"WITH {GAPS} SELECT series, date, round(value, 6) AS value FROM ff")
def forward_fill(spark, sf):
    return rounded(impute.forward_fill(_grid(spark, sf), ["series"]), 6, "value")


@query("w2_gap_lengths", f"WITH {GAPS}, {gap_cte('grid', 'g')} SELECT series, date, gap::BIGINT AS gap FROM g")
def gap_lengths(spark, sf):
    return impute.gap_lengths(_grid(spark, sf), ["series"]).select("series", "date", "gap")


@query("w3_spline_fill", f"WITH RECURSIVE {GAPS}, {spline_cte('ff', 'sp')} SELECT series, date, round(value, 6) AS value FROM sp")
def spline_fill(spark, sf):
    return rounded(impute.spline_fill(impute.forward_fill(_grid(spark, sf), ["series"]), ["series"]), 6, "value")


@query("w4_seasonal_fill", f"WITH {SEASONAL} SELECT series, date, round(value, 6) AS value FROM filled")
def seasonal_fill(spark, sf):
    return rounded(impute.seasonal_fill(impute.forward_fill(_grid(spark, sf), ["series"]), ["series"]), 6, "value")


@query("w3_full_imputation", f"""WITH RECURSIVE {GAPS}, {spline_cte('ff', 'sp')}, {seasonal_cte('sp', 'filled')}
SELECT series, date, round(value, 6) AS value FROM filled""")
def full_imputation(spark, sf):
    return rounded(impute.impute(_grid(spark, sf), ["series"]), 6, "value")


@query("a11_gap_report", f"""WITH {GAPS}, {gap_cte('ff', 'g')}
SELECT series, count(*) AS total_null, count(DISTINCT run) AS n_blocks, max(gap)::BIGINT AS max_block_len,
list(date ORDER BY date) AS dates FROM g WHERE value IS NULL GROUP BY series""")
def gap_report(spark, sf):
    return impute.gap_report(impute.forward_fill(_grid(spark, sf), ["series"]), ["series"])


@query("f14_volatility_scale", f"""WITH {PANEL} SELECT series, round(avg(exp(0.5 * h)), 6) AS mean_vol,
round(quantile_cont(exp(0.5 * h), 0.05), 6) AS lo, round(quantile_cont(exp(0.5 * h), 0.95), 6) AS hi
FROM (SELECT series, value / 1000 AS h FROM panel) GROUP BY series""")
def volatility_scale(spark, sf):
    h = b.daily_by_area(spark, sf).select("series", volatility(F.col("value") / 1000).alias("v"))
    return rounded(h.groupBy("series").agg(
        F.avg("v").alias("mean_vol"), F.percentile("v", 0.05).alias("lo"), F.percentile("v", 0.95).alias("hi")),
        6, "mean_vol", "lo", "hi")


# ---- further scans, sinks and small operators ---------------------------------------------------


def _fed(spark, rows, kind, sep):
    """Rows written as a text feed of a kind, with its header names; the folder."""
    headers = {canonical: header for header, (canonical, _) in FEEDS[kind].columns.items()}
    folder = scratch_path(spark, kind)
    text = rows.select(*[F.col(c).cast("string").alias(headers[c]) for c in rows.columns])
    text.write.option("header", True).option("sep", sep).csv(folder)
    return folder


@query("s1_generation_text_scan", "SELECT ts, 'A' || (user_id % 10) AS area, event_type AS production, value AS mw FROM events")
def generation_text_scan(spark, sf):
    folder = _fed(spark, b.readings(spark, sf), "generation", "\t")
    return market.read_feed(spark, "generation", market.expand_paths(spark, [f"{folder}/*.csv"]))


@query("s2_load_text_scan", "SELECT ts, 'A' || (user_id % 10) AS area, value AS mw FROM events")
def load_text_scan(spark, sf):
    """Half of the files with commas, half with tabs: the separator is found file by file."""
    rows = b.readings(spark, sf).drop("production")
    odd = F.pmod(F.xxhash64("ts", "area", "mw"), F.lit(2)) == 1
    folders = [_fed(spark, rows.where(odd), "load", ","), _fed(spark, rows.where(~odd), "load", "\t")]
    return market.read_feed(spark, "load", market.expand_paths(spark, [f"{f}/*.csv" for f in folders]))


@query("s3_price_text_scan", "SELECT o_orderdate AS ts, n_name AS zone, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def price_text_scan(spark, sf):
    folder = _fed(spark, b.prices(spark, sf).select("ts", "zone", "price"), "price", ",")
    return market.read_feed(spark, "price", market.expand_paths(spark, [f"{folder}/*.csv"]))


@query("s4_generation_forecast_text_scan", """SELECT l_shipdate AS ts, r_name AS area, round(l_extendedprice * (1 - l_discount), 6) AS mw
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def generation_forecast_text_scan(spark, sf):
    folder = _fed(spark, b.generation_forecast(spark, sf), "generation_forecast", "\t")
    return rounded(market.read_feed(spark, "generation_forecast", market.expand_paths(spark, [f"{folder}/*.csv"])), 6, "mw")


@query("s5_load_forecast_text_scan", """SELECT o_orderdate AS ts, r_name AS area, o_totalprice AS mw FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def load_forecast_text_scan(spark, sf):
    folder = _fed(spark, b.load_forecast(spark, sf), "load_forecast", "\t")
    return market.read_feed(spark, "load_forecast", market.expand_paths(spark, [f"{folder}/*.csv"]))


@query("s6_s7_capacity_folder_scan", f"""WITH {TRANSFERS} SELECT datetime, from_code::VARCHAR AS from_code, from_map,
to_code::VARCHAR AS to_code, to_map, capacity_mw, contract_type, resolution FROM raw""")
def capacity_folder_scan(spark, sf):
    rows = b.transfers(spark, sf).drop(*b.CAPACITY_ORDER).withColumn("from_name", F.col("from_map")).withColumn("to_name", F.col("to_map"))
    scanned = market.read_capacity_dir(spark, _fed(spark, rows, "transfer_capacity", "\t"))
    return scanned.select("datetime", "from_code", "from_map", "to_code", "to_map", "capacity_mw", "contract_type", "resolution")


@query("p2_area_filter", "SELECT ts, 'A' || (user_id % 10) AS area, value AS mw FROM events WHERE user_id % 10 <> 9")
def area_filter(spark, sf):
    rows = b.readings(spark, sf)
    return rows.where(F.col("area").isin(b.AREAS)).select("ts", "area", "mw")


@query("p5_canonical_columns", f"""WITH {TRANSFERS} SELECT datetime, from_code::VARCHAR AS from_code, from_map AS from_name, from_map,
to_code::VARCHAR AS to_code, to_map AS to_name, to_map, capacity_mw, contract_type, resolution FROM raw""")
def canonical_columns(spark, sf):
    """A feed that was written as a table, under header names in another order and among columns of its own, renamed."""
    headers = {canonical: header for header, (canonical, _) in FEEDS["transfer_capacity"].columns.items()}
    rows = b.transfers(spark, sf).withColumn("from_name", F.col("from_map")).withColumn("to_name", F.col("to_map"))
    foreign = rows.select(
        F.lit("v1").alias("Version"), *[F.col(c).alias(headers[c]) for c in sorted(headers, reverse=True)], F.col("l_partkey").alias("capacity_mw"))
    path = scratch_path(spark, "table")
    foreign.write.parquet(path)
    return market.canonical(spark.read.parquet(path), "transfer_capacity")


_COMMAND_AREAS = AREA_CODES[:10]


@query("s15_load_command", "SELECT ts::DATE AS date, " + ", ".join(
    f'coalesce(round(avg(value) FILTER (WHERE user_id % 10 = {k}), 6), 0) AS "{code}_Load"' for k, code in enumerate(_COMMAND_AREAS)) + " FROM events GROUP BY ALL")
def load_command(spark, sf):
    """The load command as a user runs it: text files in, options, a panel file out, which is read back."""
    code = F.get(F.array(*[F.lit(c) for c in _COMMAND_AREAS]), (F.col("user_id") % 10).cast("int"))
    rows = b.table(spark, sf, "events").select("ts", code.alias("area"), F.col("value").alias("mw"))
    # A code that the command leaves out.
    other = b.table(spark, sf, "events").select("ts", F.lit("ZZ").alias("area"), F.col("value").alias("mw"))
    folder, out = _fed(spark, rows.unionByName(other), "load", "\t"), scratch_path(spark, "command")
    jobs.main(["load", f"{folder}/*.csv", "-o", out])
    wide = tables.read_panel_csv(spark, out)
    return rounded(wide, 6, *wide.columns[1:])


@query("t1_sorted_panel", f"""WITH {EVENTS} SELECT date, country, variable, round(value, 4) AS value FROM gen""")
def sorted_panel(spark, sf):
    return rounded(_generation(spark, sf), 4, "value").orderBy("date", "country", "variable")


@query("t7_preview", f"""WITH {EVENTS} SELECT date, country, round(value, 6) AS value FROM load ORDER BY date, country LIMIT 3""")
def preview(spark, sf):
    daily = ingest.load_daily(b.readings(spark, sf), b.AREAS)
    return rounded(daily.orderBy("date", "country").limit(3), 6, "value")


@query("a13_panel_range", f"""WITH {RESERVE} SELECT variable, round(min(value), 2) AS low, round(max(value), 2) AS high FROM (
SELECT 'Price' AS variable, max(price) AS value FROM price_rows GROUP BY date UNION ALL SELECT 'Load', value FROM lf) GROUP BY variable""")
def panel_range(spark, sf):
    rows = ingest.price_rows(b.prices(spark, sf), b.zones(spark, sf))
    top = rows.groupBy("date").agg(F.max("price").alias("value")).select(F.lit("Price").alias("variable"), "value")
    both = top.unionByName(_load_forecast(spark, sf).select(F.lit("Load").alias("variable"), "value"))
    return rounded(panel.moments(both, ["variable"]).select("variable", "low", "high"), 2, "low", "high")


@query("s9_block_panel_scan", f"""WITH {EVENTS} SELECT variable, count(*) AS n, count(DISTINCT date) AS days FROM gen
GROUP BY variable""")
def block_panel_scan(spark, sf):
    """Panel stored by block (Y, X), read back with the check that both cover the same days."""
    path = scratch_path(spark, "blocks")
    block = F.when(F.col("variable") == "Buy", "Y").otherwise("X")
    dense = panel.on_calendar(_generation(spark, sf), b.calendar(spark, sf))
    tables.write_panel(dense.withColumn("block", block), path)
    y, x = tables.read_panel(spark, path)
    return y.unionByName(x).where("value IS NOT NULL").groupBy("variable").agg(
        F.count("*").alias("n"), F.countDistinct("date").alias("days"))


@query("s11_country_list_scan", "SELECT r_regionkey AS idx, r_name AS country FROM region")
def country_list_scan(spark, sf):
    path = scratch_path(spark, "countries")
    tables.write_countries(b.regions(spark, sf), path)
    return tables.read_countries(spark, path)


def _assembled(spark, sf):
    flags = F.when(F.col("l_returnflag") == "A", "Wind").when(F.col("l_returnflag") == "N", "Solar").otherwise("Hydro")
    items = b.table(spark, sf, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), flags.alias("variable"), "l_quantity")
    generation = (
        items.join(b.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(b.zone_dim(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("date", "country", "variable").agg(F.sum("l_quantity").alias("value")))
    named = lambda df, v: df.select("date", "country", F.lit(v).alias("variable"), "value")
    return assemble.assemble(
        generation, named(_load_forecast(spark, sf), "Load"), named(_price(spark, sf), "Price"),
        named(_reserve(spark, sf), "RM"), b.regions(spark, sf))


# The feeds on their common calendar, repaired and standardised; series are named as wide columns are.
ASSEMBLED = RESERVE + f""",
made AS (SELECT l_shipdate::DATE AS date, country, CASE l_returnflag WHEN 'A' THEN 'Wind' WHEN 'N' THEN 'Solar' ELSE 'Hydro' END AS variable,
           sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN zone ON s_nationkey = n_nationkey GROUP BY ALL),
feeds AS (SELECT date, country, 'Price' AS variable, value FROM price UNION ALL SELECT date, country, 'Load', value FROM lf
          UNION ALL SELECT date, country, variable, value FROM made UNION ALL SELECT date, country, 'RM', value FROM rm),
common AS (SELECT date FROM price INTERSECT SELECT date FROM lf INTERSECT SELECT date FROM made INTERSECT SELECT date FROM rm),
listed AS (SELECT DISTINCT country, variable FROM feeds WHERE country IN (SELECT r_name FROM region)
           AND country IN (SELECT country FROM price) AND country IN (SELECT country FROM lf)),
grid AS (SELECT country || '_' || variable AS series, date, CASE WHEN variable IN ('Price', 'RM') THEN value ELSE coalesce(value, 0) END AS value
         FROM listed CROSS JOIN common LEFT JOIN feeds USING (country, variable, date)),
ff AS (SELECT series, date, last_value(value IGNORE NULLS) OVER (
         PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM grid),
{spline_cte('ff', 'sp')}, {seasonal_cte('sp', 'filled')},
scaled AS (SELECT date, split_part(series, '_', 1) AS country, split_part(series, '_', 2) AS variable, value,
             avg(value) OVER w AS mean, CASE WHEN stddev_samp(value) OVER w < 1e-10 THEN 1 ELSE stddev_samp(value) OVER w END AS std
           FROM filled WHERE series NOT IN ({", ".join(f"'{v}'" for v in DROPPED_VARIABLES)}) WINDOW w AS (PARTITION BY series))"""


@query("k3_assembled_panel", f"""WITH RECURSIVE {ASSEMBLED} SELECT date, country, variable, round(value, 6) AS value,
round((value - mean) / std, 6) AS z FROM scaled""")
def assembled_panel(spark, sf):
    """The whole way from the daily feeds to the standardised panel."""
    done = _assembled(spark, sf)
    both = done.endogenous.unionByName(done.exogenous)
    return rounded(both.select("date", "country", "variable", "value", "z"), 6, "value", "z")


@query("k3_scaling_vectors", f"""WITH RECURSIVE {ASSEMBLED} SELECT country, variable, round(max(mean), 4) AS mean, round(max(std), 4) AS std
FROM scaled WHERE variable IN ('Price', 'Load') GROUP BY ALL""")
def scaling_vectors(spark, sf):
    done = _assembled(spark, sf)
    return rounded(assemble.scaling(done.endogenous), 4, "mean", "std")
