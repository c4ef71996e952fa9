"""Series, panel and forecast operators on orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import atlas, forecast, panels
from cadastra.plans.sql import half_even
from cadastra.sources.tables import load

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
METRICS = ["quantity", "line_count"]
WEIGHTS = {"quantity": 0.7, "line_count": 0.3}
ROLES = {"population": "line_count", "nightlight": "quantity", "builtup_area": "quantity"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records with a year and a type."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("type_label"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by year as units; a year without quantities, or without lines, is a gap."""
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").cast("string").alias("unit_id"), F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("quantity"), F.count("*").cast("double").alias("line_count"), F.concat(F.lit("unit "), F.max("l_suppkey").cast("string")).alias("unit_name")
    )


def years(df: DataFrame, column: str) -> tuple[int, int]:
    """First and last year of a date column; 2000 for an empty table."""
    ends = df.agg(F.min(F.year(column)).alias("a"), F.max(F.year(column)).alias("b")).first()
    return (ends["a"], ends["b"]) if ends["a"] is not None else (2000, 2000)


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = years(load(spark, sf_dir, "lineitem"), "l_shipdate")
    return panels.expand_panel(panel(spark, sf_dir), METRICS, first, last, ["unit_name"])


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.indices(panels.yearly_changes(expanded(spark, sf_dir), METRICS), WEIGHTS, ROLES)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.bround(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def q_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.annual_counts(records(spark, sf_dir))


def q_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.annual_by_type(records(spark, sf_dir), PRIORITIES)


def q_by_type_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.to_long(q_by_type(spark, sf_dir), ["year"], PRIORITIES, "type_label", "type_count")


def q_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(expanded(spark, sf_dir))


def q_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panels.yearly_changes(expanded(spark, sf_dir), METRICS)
    return rounded(df.select("unit_id", "year", *(f"{m}_{k}" for m in METRICS for k in ("yoy_abs", "yoy_pct", "log_change"))))


def q_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{m}_{k}" for m in METRICS for k in ("score", "change_score")]
    return rounded(indexed(spark, sf_dir).select("unit_id", "year", *names, "vitality_index", "change_intensity_index", "change_type"), 5)


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.national_summary(indexed(spark, sf_dir), METRICS), 5)


def q_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.shares(indexed(spark, sf_dir), "change_type", "year"))


def q_nowcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("status_line_count", F.lit("observed"))
    last = years(load(spark, sf_dir, "lineitem"), "l_shipdate")[1]
    return panels.carry_forward(p, ["unit_id"], [last, last + 1, last + 2], "status_line_count", "nowcast").select("unit_id", "year", "line_count", "status_line_count")


def yearly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("target"), F.year("o_orderdate").alias("year"))
    return o.agg(F.count("*").cast("double").alias("value"))


def q_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels_trend(spark, sf_dir), 4)


def panels_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.trend_line(yearly_events(spark, sf_dir), 5, ["target"])


def q_high_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.high_years(q_annual(spark, sf_dir), "total_count", "year", 3)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indicators by year, filled over the history and five years ahead."""
    orders = load(spark, sf_dir, "orders")
    o = orders.groupBy(F.year("o_orderdate").alias("year"))
    o = o.agg(F.count("*").cast("double").alias("gdp_count"), F.countDistinct("o_custkey").cast("double").alias("population_buyers"))
    first, last = years(orders, "o_orderdate")
    filled = panels.fill_indicators(o, ["gdp_count", "population_buyers"], first, last + 5)
    return panels.exogenous_features(filled, ["gdp_count", "population_buyers"])


def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir))


def q_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = forecast.forecast_series(yearly_events(spark, sf_dir), 5, features(spark, sf_dir), ["log_gdp_count", "population_buyers_growth_rate"])
    return forecast.with_interval(got, "chosen_forecast").withColumn("weights", F.to_json("weights"))


def q_panel_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = years(load(spark, sf_dir, "lineitem"), "l_shipdate")[1]
    return forecast.forecast_panel(expanded(spark, sf_dir), METRICS, last + 1, last + 5)


def q_count_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = years(load(spark, sf_dir, "lineitem"), "l_shipdate")[1]
    return forecast.forecast_counts(panel(spark, sf_dir), ["line_count"], last + 1, last + 5)


def q_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.census_curve(spark)


def q_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.national_series(spark)


def q_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumns({"source_quantity": F.when(F.col("year") % 2 == 0, "ledger"), "line_count": F.col("line_count") - 5})
    return panels.validate_panel(p, METRICS, ["unit_id", "year", *METRICS])


_PANEL = """
panel AS (SELECT CAST(l_suppkey AS VARCHAR) AS unit_id, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS line_count, 'unit ' || max(l_suppkey) AS unit_name FROM lineitem GROUP BY 1, 2)
"""


def _filled(m: str) -> str:
    w = "PARTITION BY unit_id ORDER BY year"
    known = f"CASE WHEN {m} IS NOT NULL THEN {{'y': year, 'v': {m}}} END"
    return (
        f"last_value({known} IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS b_{m}, "
        f"first_value({known} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a_{m}"
    )


def _value(m: str) -> str:
    return f"CASE WHEN {m} IS NOT NULL THEN {m} WHEN b_{m} IS NOT NULL AND a_{m} IS NOT NULL THEN b_{m}.v + (a_{m}.v - b_{m}.v) * (year - b_{m}.y) / (a_{m}.y - b_{m}.y) END"


_EXPANDED = f"""{_PANEL}, ends AS (SELECT min(year) AS a, max(year) AS b FROM panel),
u AS (SELECT unit_id, max(unit_name) AS unit_name FROM panel GROUP BY 1),
s AS (SELECT unit_id, unit_name, CAST(unnest(range(a, b + 1)) AS INTEGER) AS year FROM u, ends),
j AS (SELECT s.*, quantity, line_count FROM s LEFT JOIN panel USING (unit_id, year)),
k AS (SELECT *, {', '.join(_filled(m) for m in METRICS)} FROM j),
f AS (SELECT unit_id, unit_name, year, {', '.join(f"{_value(m)} AS {m}, CASE WHEN {m} IS NOT NULL THEN 'observed' WHEN {_value(m)} IS NOT NULL THEN 'interpolated' END AS status_{m}, CASE WHEN {m} IS NULL AND {_value(m)} IS NOT NULL THEN 'linear_interpolation_between_observed_years' END AS source_{m}" for m in METRICS)} FROM k),
expanded AS (SELECT *, CASE WHEN status_quantity IS NULL AND status_line_count IS NULL THEN 'missing' WHEN coalesce(status_quantity = 'interpolated', false) OR coalesce(status_line_count = 'interpolated', false) THEN 'interpolated' ELSE 'observed' END AS row_stage FROM f)
"""


def _change(m: str) -> str:
    before = f"lag({m}) OVER w"
    return (
        f"{m} - {before} AS {m}_yoy_abs, CASE WHEN abs({before}) > 1e-12 THEN ({m} - {before}) / {before} END AS {m}_yoy_pct, "
        f"ln(1 + CASE WHEN {m} < 0 THEN 0 ELSE {m} END) - ln(1 + CASE WHEN {before} < 0 THEN 0 ELSE {before} END) AS {m}_log_change"
    )


_CHANGES = f"{_EXPANDED}, changes AS (SELECT *, {', '.join(map(_change, METRICS))} FROM expanded WINDOW w AS (PARTITION BY unit_id ORDER BY year))"


def _score(x: str, name: str) -> str:
    q = lambda p: f"quantile_cont({x}, {p}) OVER (PARTITION BY year)"
    return (
        f"CASE WHEN {x} IS NULL OR count({x}) OVER (PARTITION BY year) < 2 THEN NULL WHEN {q(0.99)} <= {q(0.01)} THEN 50.0 "
        f"ELSE (least(greatest({x}, {q(0.01)}), {q(0.99)}) - {q(0.01)}) / ({q(0.99)} - {q(0.01)}) * 100 END AS {name}"
    )


def _mean(kind: str) -> str:
    total = " + ".join(f"coalesce({m}_{kind} * {w}, 0)" for m, w in WEIGHTS.items())
    weight = " + ".join(f"CASE WHEN {m}_{kind} IS NOT NULL THEN {w} ELSE 0 END" for m, w in WEIGHTS.items())
    return f"CASE WHEN ({weight}) <> 0 THEN CAST(({total}) AS DOUBLE) / ({weight}) END"


_INDEXED = f"""{_CHANGES},
sc AS (SELECT *, {', '.join(_score(m, f'{m}_score') + ', ' + _score(f'abs({m}_yoy_pct)', f'{m}_change_score') for m in METRICS)} FROM changes),
ix AS (SELECT *, {_mean('score')} AS vitality_index, {_mean('change_score')} AS change_intensity_index FROM sc),
indexed AS (SELECT *, CASE WHEN line_count_yoy_pct < -0.02 AND quantity_yoy_pct < -0.02 THEN 'shrinking' WHEN quantity_yoy_pct > 0.03 AND quantity_yoy_pct > 0.01 THEN 'urbanizing'
  WHEN vitality_index >= 70 AND change_intensity_index >= 50 THEN 'fast_growth' WHEN vitality_index <= 30 AND change_intensity_index >= 50 THEN 'rapid_decline_or_transition'
  WHEN change_intensity_index < 20 THEN 'stable' ELSE 'mixed' END AS change_type FROM ix)
"""
_RECORDS = "records AS (SELECT o_orderkey AS record_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS type_label FROM orders), span AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM records)"
_ANNUAL = f"{_RECORDS}, annual AS (SELECT year, count(DISTINCT record_id) AS total_count, count(record_id) > 0 AS source_year_present FROM span LEFT JOIN records USING (year) GROUP BY year)"


def _tail(c: str, low: float, high: float) -> str:
    """Values of ``c`` by year with five more, each grown by the mean of the last five growth rates."""
    rate = "list_transform(range(greatest(2, len(v) - 4), len(v) + 1), lambda i: CASE WHEN v[i - 1] <> 0 THEN v[i] / v[i - 1] - 1 END)"
    mean = f"coalesce(list_sum(list_filter({rate}, lambda g: g IS NOT NULL)) / nullif(len(list_filter({rate}, lambda g: g IS NOT NULL)), 0), 0)"
    return f"""{c}_tail AS (SELECT 0 AS k, list({c} ORDER BY year) AS v, min(year) AS y FROM yearly UNION ALL
  SELECT k + 1, list_append(v, v[-1] * (1 + least(greatest({mean}, {low}::DOUBLE), {high}::DOUBLE))), y FROM {c}_tail WHERE k < 5)"""


def _r(cols: list[str], places: int) -> str:
    return ", ".join(f"{half_even(c, places)} AS {c}" for c in cols)


_GDP, _PEOPLE = panels.growth_bounds("gdp_count"), panels.growth_bounds("population_buyers")
_FEATURES = f"""WITH RECURSIVE span AS (SELECT CAST(unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS INTEGER) AS year FROM orders),
own AS (SELECT year(o_orderdate) AS year, CAST(count(*) AS DOUBLE) AS gdp_count, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS population_buyers FROM orders GROUP BY 1),
gaps AS (SELECT span.year, gdp_count, population_buyers FROM span LEFT JOIN own USING (year)),
marked AS (SELECT *, last_value(CASE WHEN gdp_count IS NOT NULL THEN {{'y': year, 'g': gdp_count, 'p': population_buyers}} END IGNORE NULLS) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) AS b,
  first_value(CASE WHEN gdp_count IS NOT NULL THEN {{'y': year, 'g': gdp_count, 'p': population_buyers}} END IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM gaps),
yearly AS (SELECT year, coalesce(gdp_count, b.g + (a.g - b.g) * (year - b.y) / (a.y - b.y)) AS gdp_count, coalesce(population_buyers, b.p + (a.p - b.p) * (year - b.y) / (a.y - b.y)) AS population_buyers FROM marked),
{_tail("gdp_count", *_GDP)},
{_tail("population_buyers", *_PEOPLE)},
f AS (SELECT CAST(y + unnest(range(len(g.v))) AS INTEGER) AS year, unnest(g.v) AS gdp_count, unnest(p.v) AS population_buyers FROM gdp_count_tail g JOIN population_buyers_tail p USING (k, y) WHERE k = 5),
x AS (SELECT f.*, CASE WHEN own.year IS NOT NULL THEN 'actual' ELSE 'estimated' END AS economic_data_status, lag(f.gdp_count) OVER o AS g0, lag(f.population_buyers) OVER o AS p0 FROM f LEFT JOIN own USING (year) WINDOW o AS (ORDER BY f.year)),
z AS (SELECT year, economic_data_status, gdp_count, population_buyers, CASE WHEN gdp_count > 0 THEN ln(gdp_count) END AS log_gdp_count, CASE WHEN population_buyers > 0 THEN ln(population_buyers) END AS log_population_buyers,
  coalesce((gdp_count - g0) / nullif(g0, 0) * 100, 0) AS gdp_count_growth_rate, coalesce((population_buyers - p0) / nullif(p0, 0) * 100, 0) AS population_buyers_growth_rate FROM x)
"""
_CHANGE_COLUMNS = [f"{m}_{k}" for m in METRICS for k in ("yoy_abs", "yoy_pct", "log_change")]
_INDEX_COLUMNS = [f"{m}_{k}" for m in METRICS for k in ("score", "change_score")] + ["vitality_index", "change_intensity_index"]

QUERIES = {
    "annual_counts": q_annual,
    "annual_by_type": q_by_type,
    "annual_by_type_long": q_by_type_long,
    "panel_expanded": q_expanded,
    "panel_changes": q_changes,
    "panel_indices": q_indices,
    "panel_summary": q_summary,
    "change_type_shares": q_shares,
    "panel_nowcast": q_nowcast,
    "panel_validation": q_validation,
    "trend_line": q_trend,
    "high_years": q_high_years,
    "census_curve": q_census,
    "national_series": q_national,
    "exogenous_features": q_features,
    "series_forecast": q_forecast,
    "panel_forecast": q_panel_forecast,
    "count_forecast": q_count_forecast,
}
ORACLES = {
    "exogenous_features": f"{_FEATURES} SELECT year, economic_data_status, {_r(['gdp_count', 'population_buyers', 'log_gdp_count', 'log_population_buyers', 'gdp_count_growth_rate', 'population_buyers_growth_rate'], 6)} FROM z",
    "annual_counts": f"WITH {_ANNUAL} SELECT * FROM annual",
    "annual_by_type": f"""WITH {_RECORDS} SELECT span.year, {', '.join(f"count(DISTINCT record_id) FILTER (type_label = '{p}') AS \"{p}\"" for p in PRIORITIES)} FROM span LEFT JOIN records USING (year) GROUP BY 1""",
    "annual_by_type_long": f"""WITH {_RECORDS}, t AS (SELECT unnest({PRIORITIES}) AS type_label)
SELECT span.year, t.type_label, count(DISTINCT record_id) AS type_count FROM span CROSS JOIN t LEFT JOIN records r ON r.year = span.year AND r.type_label = t.type_label GROUP BY 1, 2""",
    "panel_expanded": f"WITH {_EXPANDED} SELECT unit_id, unit_name, year, {_r(METRICS, 6)}, status_quantity, source_quantity, status_line_count, source_line_count, row_stage FROM expanded",
    "panel_changes": f"WITH {_CHANGES} SELECT unit_id, year, {_r(_CHANGE_COLUMNS, 6)} FROM changes",
    "panel_indices": f"WITH {_INDEXED} SELECT unit_id, year, {_r(_INDEX_COLUMNS, 5)}, change_type FROM indexed",
    "panel_summary": f"""WITH {_INDEXED}, a AS (SELECT year, {', '.join(f'sum({m}) AS {m}_sum, avg({m}) AS {m}_mean' for m in METRICS)}, avg(vitality_index) AS vitality_index_mean,
  avg(change_intensity_index) AS change_intensity_index_mean, avg(CASE WHEN row_stage = 'forecast' THEN 1.0 ELSE 0.0 END) AS forecast_share FROM indexed GROUP BY year)
SELECT year, {_r([f'{m}_{k}' for m in METRICS for k in ('sum', 'mean')] + ['vitality_index_mean', 'change_intensity_index_mean', 'forecast_share'], 5)} FROM a""",
    "change_type_shares": f"WITH {_INDEXED}, c AS (SELECT year, change_type, count(*) AS count FROM indexed GROUP BY 1, 2), d AS (SELECT *, count / sum(count) OVER (PARTITION BY year) AS share FROM c) SELECT year, change_type, count, {_r(['share'], 6)} FROM d",
    "panel_nowcast": f"""WITH {_PANEL}, l AS (SELECT *, max(year) OVER (PARTITION BY unit_id) AS m, max(year) OVER () AS e FROM panel)
SELECT unit_id, year, line_count, 'observed' AS status_line_count FROM panel UNION ALL
SELECT unit_id, CAST(y AS INTEGER), line_count, 'nowcast' FROM (SELECT *, unnest([e, e + 1, e + 2]) AS y FROM l WHERE year = m) WHERE y > year""",
    "trend_line": f"""WITH h AS (SELECT o_orderpriority AS target, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
f AS (SELECT target, coalesce(regr_slope(value, year), 0) AS w, avg(year) AS x, avg(value) AS y, max(year) AS e FROM h GROUP BY 1),
g AS (SELECT *, CAST(e + unnest(range(1, 6)) AS INTEGER) AS year FROM f), v AS (SELECT target, year, greatest(y + w * (year - x), 0.0) AS forecast FROM g) SELECT target, year, {_r(['forecast'], 4)} FROM v""",
    "high_years": f"WITH {_ANNUAL} SELECT *, CAST(row_number() OVER (ORDER BY total_count DESC, year) AS INTEGER) AS rank FROM annual QUALIFY rank <= 3",
    "census_curve": """WITH c AS (SELECT 3170000.0::DOUBLE AS v, 3170000.0::DOUBLE / (1 - 0.038::DOUBLE) AS b), r AS (SELECT *, ln(v / b) / 10 AS g FROM c),
y AS (SELECT *, CAST(unnest(range(2006, 2036)) AS INTEGER) AS year FROM r)
SELECT year, CAST(round_even(CASE WHEN year = 2006 THEN b WHEN year = 2016 THEN v WHEN year < 2016 THEN b * exp(g * (year - 2006)) WHEN year <= 2026 THEN v * exp(g * (year - 2016))
  ELSE v * exp(g * 10) * exp(g * (0.9::DOUBLE * (1 - pow(0.9::DOUBLE, year - 2026)) / (1 - 0.9::DOUBLE))) END, 0) AS BIGINT) AS natural_village_count,
  CASE WHEN year = 2006 THEN 'derived_observed' WHEN year = 2016 THEN 'observed' WHEN year < 2016 THEN 'interpolated' WHEN year <= 2026 THEN 'nowcast' ELSE 'forecast' END AS status_natural_village_count FROM y""",
    "panel_validation": f"""WITH {_PANEL}, p AS (SELECT *, CASE WHEN year % 2 = 0 THEN 'ledger' END AS source_quantity FROM panel), q AS (SELECT unit_id, year, quantity, source_quantity, line_count - 5 AS line_count FROM p),
h AS (SELECT unit_id, count(quantity) AS a, count(line_count) AS b FROM q GROUP BY 1),
r AS (SELECT 'error' AS level, 'negative' AS "check", 'quantity' AS metric, count(*) FILTER (quantity < 0) AS count FROM q UNION ALL SELECT 'error', 'negative', 'line_count', count(*) FILTER (line_count < 0) FROM q
 UNION ALL SELECT 'warning', 'no_source', 'quantity', count(*) FILTER (quantity IS NOT NULL AND source_quantity IS NULL) FROM q
 UNION ALL SELECT 'warning', 'short_history', 'quantity', count(*) FILTER (a < 4) FROM h UNION ALL SELECT 'warning', 'short_history', 'line_count', count(*) FILTER (b < 4) FROM h) SELECT * FROM r WHERE count > 0""",
}
