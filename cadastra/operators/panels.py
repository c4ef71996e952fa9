"""Yearly series and unit-by-year panels: dense years, gap filling, changes, scores, indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stages of a row by precedence, and the statuses that lead to each.
STAGES = [
    ("forecast", ["forecast", "weak_history_forecast"]),
    ("nowcast", ["nowcast"]),
    ("interpolated", ["interpolated"]),
]


def year_spine(df: DataFrame, keys: list[str], year: str = "year", first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Every year from first to last for each key, by default the key's own range."""
    span = df.where(F.col(year).isNotNull()).groupBy(*keys).agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    start, end = first if first is not None else F.col("_a"), last if last is not None else F.col("_b")
    return span.select(*keys, F.explode(F.when(start <= end, F.sequence(start.cast("int"), end.cast("int")))).alias(year))


def annual_counts(records: DataFrame, record: str = "record_id", year: str = "year") -> DataFrame:
    """Distinct records of each year in the whole range, 0 and a flag where there are none."""
    counts = records.where(F.col(year).isNotNull()).groupBy(year).agg(F.countDistinct(record).alias("total_count"), F.lit(True).alias("_there"))
    whole = counts.agg(F.min(year).alias("a"), F.max(year).alias("b")).select(F.explode(F.sequence("a", "b")).alias(year))
    out = whole.join(counts, year, "left")
    return out.select(year, F.coalesce("total_count", F.lit(0)).alias("total_count"), F.coalesce("_there", F.lit(False)).alias("source_year_present"))


def annual_by_type(records: DataFrame, types: list[str], record: str = "record_id", type_: str = "type_label", year: str = "year") -> DataFrame:
    """One column of distinct records per type, on the whole range of years, 0 where none.

    The types are given, so the pivot needs no extra pass and its width is bounded."""
    rows = records.where(F.col(year).isNotNull())
    wide = rows.groupBy(year).pivot(type_, types).agg(F.countDistinct(record))
    span = rows.agg(F.min(year).alias("a"), F.max(year).alias("b")).select(F.explode(F.sequence("a", "b")).alias(year))
    return span.join(wide, year, "left").na.fill(0, types)


def to_long(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def known(value: str, year: str, keys: list[str]) -> tuple[Column, Column]:
    """(year, value) of the last known row up to this one, and of the first known row from it."""
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(year).alias("y"), F.col(value).alias("v")))
    order = Window.partitionBy(*keys).orderBy(year)
    before = F.last(pair, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(pair, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return before, after


def interpolate(df: DataFrame, value: str, keys: list[str], year: str = "year", out: str | None = None) -> DataFrame:
    """Linear by year between known values; nothing before the first or after the last."""
    before, after = known(value, year, keys)
    df = df.withColumns({"_b": before, "_a": after})
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(year) - F.col("_b.y")) / (F.col("_a.y") - F.col("_b.y"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), line)
    return df.withColumn(out or value, filled).drop("_b", "_a")


def expand_panel(df: DataFrame, metrics: list[str], first_year: int, last_year: int, static: list[str], unit: str = "unit_id") -> DataFrame:
    """One row per unit and year with gaps inside a unit's history filled, each with its status.

    Static columns take the unit's last value that isn't null. status_m is observed, what the
    input says, or interpolated; source_m tells where a filled value comes from.
    """
    facts = df.groupBy(unit).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("year"))).alias(c) for c in static))
    spine = facts.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    kept = [unit, "year"] + [c for m in metrics for c in (m, f"source_{m}", f"status_{m}") if c in df.columns]
    panel = spine.join(df.select(*kept), [unit, "year"], "left")
    for m in metrics:
        value = F.col(m).cast("string").try_cast("double") if m in df.columns else F.lit(None).cast("double")
        status = F.col(f"status_{m}") if f"status_{m}" in df.columns else F.lit(None).cast("string")
        source = F.col(f"source_{m}") if f"source_{m}" in df.columns else F.lit(None).cast("string")
        panel = panel.withColumns({m: value, f"status_{m}": status, f"source_{m}": source})
        panel = panel.withColumn(f"status_{m}", F.when(F.col(m).isNotNull(), F.coalesce(f"status_{m}", F.lit("observed"))).otherwise(F.col(f"status_{m}")))
        panel = interpolate(panel, m, [unit], out="_filled")
        new = F.col(m).isNull() & F.col("_filled").isNotNull()
        panel = panel.withColumns(
            {
                f"status_{m}": F.when(new, "interpolated").otherwise(F.col(f"status_{m}")),
                f"source_{m}": F.when(new, "linear_interpolation_between_observed_years").otherwise(F.col(f"source_{m}")),
                m: F.col("_filled"),
            }
        ).drop("_filled")
    return panel.withColumn("row_stage", row_stage(metrics))


def row_stage(metrics: list[str]) -> Column:
    """The strongest stage among the metrics that have a value: forecast, nowcast, interpolated, observed; missing without any."""
    statuses = F.array_compact(F.array(*(F.when(F.col(m).isNotNull(), F.coalesce(f"status_{m}", F.lit("observed"))) for m in metrics)))
    stage = F.when(F.size(statuses) == 0, "missing")
    for name, own in STAGES:
        stage = stage.when(F.arrays_overlap(statuses, F.array(*map(F.lit, own))), name)
    return stage.otherwise("observed")


def yearly_changes(df: DataFrame, metrics: list[str], unit: str = "unit_id") -> DataFrame:
    """m_yoy_abs, m_yoy_pct (null where the year before is 0) and m_log_change to the row before."""
    order = Window.partitionBy(unit).orderBy("year")
    cols = {}
    for m in metrics:
        now, before = F.col(m), F.lag(m).over(order)
        log = lambda x: F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x))
        cols[f"{m}_yoy_abs"] = now - before
        cols[f"{m}_yoy_pct"] = F.when(F.abs(before) > 1e-12, (now - before) / before)
        cols[f"{m}_log_change"] = log(now) - log(before)
    return df.withColumns(cols)


def robust_score(df: DataFrame, columns: dict[str, Column], keys: list[str] = ["year"], low: float = 0.01, high: float = 0.99) -> DataFrame:  # noqa: B006
    """Scores 0 to 100 between a group's 1st and 99th percentile: null with under two values, 50 where
    the percentiles meet. Percentiles are exact; one aggregation serves all columns."""
    temp = {f"_v_{name}": c for name, c in columns.items()}
    df = df.withColumns(temp)
    aggs = [F.percentile(F.col(f"_v_{n}"), F.array(F.lit(low), F.lit(high))).alias(f"_q_{n}") for n in columns]
    counts = [F.count(f"_v_{n}").alias(f"_n_{n}") for n in columns]
    df = df.join(df.groupBy(*keys).agg(*aggs, *counts), keys)
    for n in columns:
        x, a, b = F.col(f"_v_{n}"), F.get(f"_q_{n}", F.lit(0)), F.get(f"_q_{n}", F.lit(1))
        inside = F.when(x < a, a).when(x > b, b).otherwise(x)
        score = F.when(x.isNull() | (F.col(f"_n_{n}") < 2), None).when(b <= a, 50.0).otherwise((inside - a) / (b - a) * 100)
        df = df.withColumn(n, score)
    return df.drop(*(f"_{p}_{n}" for n in columns for p in "vqn"))


def weighted_mean(columns: dict[str, float]) -> Column:
    """Weighted mean of a row's columns that aren't null."""
    total = reduce(Column.__add__, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in columns.items()))
    weight = reduce(Column.__add__, (F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in columns.items()))
    return F.when(weight != 0, total / weight)


def indices(df: DataFrame, weights: dict[str, float], roles: dict[str, str] | None = None) -> DataFrame:
    """Per-year scores of each metric and of its change, their weighted indices and a change type.

    ``roles`` names the metrics for population, nightlight and builtup_area; a role without a
    metric counts as unknown. Needs the columns of ``yearly_changes``.
    """
    metrics = list(weights)
    scores = {f"{m}_score": F.col(m) for m in metrics} | {f"{m}_change_score": F.abs(F.col(f"{m}_yoy_pct")) for m in metrics}
    df = robust_score(df, scores)
    df = df.withColumns(
        {
            "vitality_index": weighted_mean({f"{m}_score": w for m, w in weights.items()}),
            "change_intensity_index": weighted_mean({f"{m}_change_score": w for m, w in weights.items()}),
        }
    )
    roles = roles or {k: k for k in ("population", "nightlight", "builtup_area")}
    pct = lambda role: F.col(f"{roles[role]}_yoy_pct") if f"{roles.get(role)}_yoy_pct" in df.columns else F.lit(None).cast("double")
    pop, light, built = pct("population"), pct("nightlight"), pct("builtup_area")
    vitality, change = F.col("vitality_index"), F.col("change_intensity_index")
    label = (
        F.when((pop < -0.02) & (light < -0.02), "shrinking")
        .when((built > 0.03) & (light > 0.01), "urbanizing")
        .when((vitality >= 70) & (change >= 50), "fast_growth")
        .when((vitality <= 30) & (change >= 50), "rapid_decline_or_transition")
        .when(change < 20, "stable")
        .otherwise("mixed")
    )
    return df.withColumn("change_type", label)


def national_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per year: sums and means of the metrics and indices, and the share of forecast rows."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("sum", F.sum), ("mean", F.avg))]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in ("vitality_index", "change_intensity_index")]
    return df.groupBy("year").agg(*aggs, F.avg((F.col("row_stage") == "forecast").cast("double")).alias("forecast_share"))


def shares(df: DataFrame, group: str, within: str) -> DataFrame:
    """Count of each (within, group) and its share of ``within``."""
    counts = df.groupBy(within, group).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(within)))


def carry_forward(df: DataFrame, keys: list[str], years: list[int], status: str, value: str) -> DataFrame:
    """The latest year's rows of each key again for later years, with a new status; with the input."""
    latest = df.withColumn("_last", F.max("year").over(Window.partitionBy(*keys))).where("year = _last").drop("_last")
    more = latest.withColumn("_y", F.explode(F.array(*map(F.lit, years)))).where(F.col("_y") > F.col("year"))
    more = more.withColumns({"year": F.col("_y").cast(df.schema["year"].dataType), status: F.lit(value)}).drop("_y")
    return df.unionByName(more)


def extrapolate_tail(values: Column, lower: float, upper: float, last: int = 5) -> Column:
    """Array with its null tail filled: each value grows by the mean of the last growth rates of what
    stands before it, clipped. Earlier nulls stay; an all-null array becomes zeros."""

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        first = F.greatest(F.lit(2), n - last + 1)
        rates = F.transform(F.sequence(first, n), lambda i: F.try_divide(F.element_at(acc, i), F.element_at(acc, i - 1)) - 1)
        steps = F.filter(F.when(n > 1, rates).otherwise(F.array().cast("array<double>")), lambda g: g.isNotNull() & ~F.isnan(g))
        mean = F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0.0), lambda a, g: a + g) / F.size(steps)).otherwise(0.0)
        growth = F.least(F.greatest(mean, F.lit(lower)), F.lit(upper))
        grown = F.when(n > 0, F.element_at(acc, -1) * (1 + growth))
        return F.concat(acc, F.array(F.coalesce(x, grown)))

    filled = F.aggregate(values, F.array().cast("array<double>"), step)
    return F.when(F.exists(values, lambda x: x.isNotNull()), filled).otherwise(F.transform(values, lambda x: F.lit(0.0)))


def growth_bounds(column: str) -> tuple[float, float]:
    if "population" in column:
        return -0.02, 0.02
    return (-0.05, 0.15) if "gdp" in column else (-0.2, 0.2)


def fill_indicators(df: DataFrame, columns: list[str], first_year: int, last_year: int, keys: list[str] | None = None) -> DataFrame:
    """Indicators on a dense range of years: inside gaps linear, the first value before it, a growing
    tail; ``economic_data_status`` says whether a year's values are all actual."""
    keys = keys or []
    if keys:
        spine = df.select(*keys).distinct().withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    else:
        spine = df.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    rows = spine.join(df.select(*keys, "year", *columns), [*keys, "year"], "left")
    actual = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
    rows = rows.withColumn("economic_data_status", F.when(actual, "actual").otherwise("estimated"))
    for c in columns:
        before, after = known(c, "year", keys or [F.lit(1)])
        rows = rows.withColumns({"_b": before, "_a": after})
        line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("year") - F.col("_b.y")) / (F.col("_a.y") - F.col("_b.y"))
        inner = F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNotNull(), line)
        rows = rows.withColumn(c, inner).drop("_b", "_a")
    order = F.array_sort(F.collect_list(F.struct("year", "economic_data_status", *columns)))
    one = rows.groupBy(*keys).agg(order.alias("_r"))
    filled = [extrapolate_tail(F.col("_r").getField(c), *growth_bounds(c)).alias(c) for c in columns]
    one = one.select(*keys, F.col("_r.year").alias("year"), F.col("_r.economic_data_status").alias("economic_data_status"), *filled)
    return one.select(*keys, F.inline(F.arrays_zip("year", "economic_data_status", *columns)))


def exogenous_features(filled: DataFrame, columns: list[str]) -> DataFrame:
    """log_c where a value is positive, and c_growth_rate in percent (0 for the first and for a base of 0)."""
    order = Window.partitionBy(F.lit(1)).orderBy("year")
    cols = {}
    for c in columns:
        before = F.lag(c).over(order)
        cols[f"log_{c}"] = F.when(F.col(c) > 0, F.log(c))
        cols[f"{c}_growth_rate"] = F.coalesce(F.try_divide(F.col(c) - before, before) * 100, F.lit(0.0))
    return filled.withColumns(cols)


def validate_panel(df: DataFrame, metrics: list[str], required: list[str], min_history: int = 4, unit: str = "unit_id") -> DataFrame:
    """(level, check, metric, count) of everything wrong in a panel; empty when all is well."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    if missing:
        return spark.createDataFrame([("error", "missing_column", c, 1) for c in missing], "level string, check string, metric string, count long")
    found = []
    there = [m for m in metrics if m in df.columns]
    doubled = df.groupBy(unit, "year").count().where("count > 1").agg(F.count("*").alias("count"))
    found.append(doubled.select(F.lit("error").alias("level"), F.lit("duplicate_key").alias("check"), F.lit("").alias("metric"), "count"))
    number = {m: F.col(m).cast("string").try_cast("double") for m in there}
    checks = [("error", "bad_year", "", F.col("year").cast("string").try_cast("int").isNull())]
    for m in there:
        checks.append(("error", "not_numeric", m, F.col(m).isNotNull() & number[m].isNull()))
        checks.append(("error", "negative", m, number[m] < 0))
        if f"source_{m}" in df.columns:
            checks.append(("warning", "no_source", m, F.col(m).isNotNull() & (F.trim(F.coalesce(F.col(f"source_{m}"), F.lit(""))) == "")))
    counts = df.agg(*(F.count_if(c).alias(f"_{i}") for i, (_, _, _, c) in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(a).alias("level"), F.lit(b).alias("check"), F.lit(m).alias("metric"), F.col(f"_{i}").alias("count")) for i, (a, b, m, _) in enumerate(checks)))
    found.append(counts.select(F.inline(rows)))
    if there:
        history = df.groupBy(unit).agg(*(F.count(number[m]).alias(f"_{m}") for m in there))
        short = history.agg(*(F.count_if(F.col(f"_{m}") < min_history).alias(f"_{m}") for m in there))
        rows = F.array(*(F.struct(F.lit("warning").alias("level"), F.lit("short_history").alias("check"), F.lit(m).alias("metric"), F.col(f"_{m}").alias("count")) for m in there))
        found.append(short.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, found).where("count > 0")
