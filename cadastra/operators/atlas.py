"""Counts of township-level units: province panels, national series, outside indicators, configuration."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.operators import forecast, panels, spatial

COUNTS = ["township_street_count", "street_count", "town_count", "township_count", "other_township_level_count"]
#: Endings of names by class, in order.
CLASSES = {"street": "街道(办事处)?$", "town": "镇$", "township": "(乡|苏木)$"}
# Published national counts at each year's end: year, all, towns, townships, streets.
NATIONAL = [
    (2009, 40858, 19322, 14848, 6686), (2010, 40906, 19410, 14571, 6923), (2011, 40466, 19683, 13587, 7194), (2012, 40446, 19881, 13281, 7282),
    (2013, 40497, 20117, 12812, 7566), (2014, 40381, 20401, 12282, 7696), (2015, 39789, 20515, 11315, 7957), (2016, 39862, 20883, 10872, 8105),
    (2017, 39888, 21116, 10529, 8241), (2018, 39945, 21297, 10253, 8393), (2019, 38755, 21013, 9221, 8519), (2020, 38741, 21157, 8809, 8773),
    (2021, 38558, 21322, 8309, 8925), (2022, 38602, 21389, 8227, 8984), (2023, 38658, 21421, 8190, 9045), (2024, 38712, 21464, 8128, 9118),
]


def read_config(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def metric_weights(config: dict) -> dict[str, float]:
    """Weights of the configured metrics, adding to 1; even ones where they don't add to anything."""
    raw = {m: float(c.get("weight", 1.0)) for m, c in config.get("metrics", {}).items()}
    total = sum(raw.values())
    return {m: w / total if total > 0 else 1 / len(raw) for m, w in raw.items()}


def panel_schema(metrics: Sequence[str], static: Sequence[str] = ("unit_name", "level", "province", "city", "county", "township", "village")) -> T.StructType:
    """The columns of a panel: unit, place, year, and value, source and status of each metric."""
    text = [T.StructField(c, T.StringType()) for c in ("unit_id", *static)]
    place = [T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("year", T.IntegerType())]
    each = [f for m in metrics for f in (T.StructField(m, T.DoubleType()), T.StructField(f"source_{m}", T.StringType()), T.StructField(f"status_{m}", T.StringType()))]
    return T.StructType([*text, *place, *each, T.StructField("source_note", T.StringType())])


def count_panel(streets: DataFrame, centres: DataFrame, last_year: int, yearbook: DataFrame | None = None) -> DataFrame:
    """Unit and year counts from yearly name lists (year, name, provinceCode), after those of a yearbook
    (year, province, counts); gaps inside a unit's years are filled, the last year is carried to ``last_year``.

    centres: unit_id, province, lon, lat. Rows of units that it doesn't have are left out.
    """
    listed = spatial.suffix_counts(streets, ["year", "provinceCode"], "name", CLASSES)
    listed = listed.withColumnsRenamed({"street": "street_count", "town": "town_count", "township": "township_count", "other": "other_township_level_count", "total": "township_street_count"})
    listed = listed.withColumns(
        {"unit_id": F.concat(F.lpad(F.col("provinceCode").cast("string"), 2, "0"), F.lit("0000")), "source_township_street_count": F.lit("statistical_division_codes")}
    ).join(centres, "unit_id")
    keep = ["unit_id", "province", "lon", "lat", "year", *COUNTS, "source_township_street_count"]
    rows = listed.select(*keep)
    if yearbook is not None:
        rows = yearbook.join(centres, "province").select(*keep).unionByName(rows)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in COUNTS} | {"year": F.col("year").cast("int")})
    spine = panels.year_spine(rows, ["unit_id"])
    df = spine.join(rows.drop("province", "lon", "lat"), ["unit_id", "year"], "left").join(centres, "unit_id")
    df = df.withColumn("status_township_street_count", F.when(F.col(COUNTS[0]).isNotNull(), "observed").otherwise("interpolated"))
    for c in COUNTS:
        df = panels.interpolate(df, c, ["unit_id"])
    source = F.coalesce("source_township_street_count", F.lit("linear_interpolation_between_counts"))
    df = df.withColumns({c: F.rint(c).cast("long") for c in COUNTS} | {"source_township_street_count": source})
    ends = df.agg(F.max("year")).first()[0]
    years = list(range(ends + 1, last_year + 1)) if ends is not None else []
    latest = df.where(F.col("year") == F.lit(ends)) if years else df.limit(0)
    if years:
        more = latest.withColumn("_y", F.explode(F.array(*map(F.lit, years))))
        more = more.withColumns({"year": F.col("_y"), "status_township_street_count": F.lit("nowcast"), "source_township_street_count": F.lit(f"carried_forward_from_{ends}")}).drop("_y")
        df = df.unionByName(more)
    return df


def with_forecast(panel: DataFrame, first: int, last: int, outside: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """The panel with the years ahead, learned from its observed years."""
    seen = panel.where("status_township_street_count = 'observed'")
    ahead = forecast.forecast_counts(seen, COUNTS, first, last, outside, columns, ["province", "lon", "lat"])
    ahead = ahead.withColumns({"status_township_street_count": F.lit("forecast"), "source_township_street_count": F.lit("statistical_forecast_from_counts")})
    return panel.unionByName(ahead, allowMissingColumns=True)


def national_series(spark: SparkSession, now: int = 2026, first: int = 2027, last: int = 2035) -> DataFrame:
    """The published counts, their last year carried to ``now``, and a damped robust forecast."""
    rows = spark.createDataFrame(NATIONAL, "year int, township_street_count long, town_count long, township_count long, street_count long")
    other = F.col("township_street_count") - F.col("town_count") - F.col("township_count") - F.col("street_count")
    rows = rows.withColumns({"unit_id": F.lit("CN"), "other_township_level_count": other, "status_township_street_count": F.lit("observed")})
    ahead = forecast.forecast_counts(rows, COUNTS, first, last).withColumn("status_township_street_count", F.lit("forecast"))
    years = list(range(NATIONAL[-1][0] + 1, now + 1))
    held = panels.carry_forward(rows, ["unit_id"], years, "status_township_street_count", "nowcast") if years else rows
    return held.unionByName(ahead, allowMissingColumns=True)


def outside_indicators(people: DataFrame, economy: DataFrame) -> DataFrame:
    """Population and economy of units by year, whichever there is; of doubled economy rows the first by value."""
    once = economy.groupBy("unit_id", "year").agg(*(F.min(c).alias(c) for c in economy.columns if c not in ("unit_id", "year")))
    return people.join(once, ["unit_id", "year"], "full_outer")


def cell_panel(cells: DataFrame, polygons: DataFrame, year: int, size: float, metric: str) -> DataFrame:
    """Grid cells with a positive value whose centre lies in a polygon, as panel rows."""
    inside = spatial.locate(cells.where(F.col(metric) > 0), polygons, ["cell_x", "cell_y"], size=size)
    unit = F.format_string("CELL_%d_%d", "cell_x", "cell_y")
    return inside.select(unit.alias("unit_id"), F.lit("grid").alias("level"), "lon", "lat", F.lit(year).alias("year"), metric, F.lit("observed_or_modelled_epoch").alias(f"status_{metric}"))
