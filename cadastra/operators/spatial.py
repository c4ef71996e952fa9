"""Grids and polygons with built-in expressions: pixels to cells, points to polygons, ring areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grid_sum(pixels: DataFrame, lon: str, lat: str, value: str, size: float, west: float = -180.0, south: float = -90.0, keys: list[str] | None = None) -> DataFrame:
    """Values summed in square cells of ``size`` degrees; null, NaN and infinite values count as 0."""
    x, y = F.floor((F.col(lon) - west) / size), F.floor((F.col(lat) - south) / size)
    bad = F.col(value).isNull() | F.isnan(value) | F.col(value).isin(float("inf"), float("-inf"))
    cells = pixels.select(*(keys or []), x.alias("cell_x"), y.alias("cell_y"), F.when(bad, 0.0).otherwise(F.col(value)).alias("_v"))
    out = cells.groupBy(*(keys or []), "cell_x", "cell_y").agg(F.sum("_v").alias(value), F.count("*").alias("pixel_count"))
    return out.withColumns({"lon": west + (F.col("cell_x") + 0.5) * size, "lat": south + (F.col("cell_y") + 0.5) * size})


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring of [x, y] points: positive if it runs anti-clockwise."""
    step = lambda a, i: (
        F.get(F.get(ring, i), F.lit(0)) * F.get(F.get(ring, i + 1), F.lit(1)) - F.get(F.get(ring, i + 1), F.lit(0)) * F.get(F.get(ring, i), F.lit(1))
    )
    n = F.size(ring)
    places = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0.0), lambda a, i: a + step(a, i)) / 2


def rewound(polygon: Column) -> Column:
    """Rings of a polygon with the outer one clockwise and its holes the other way."""
    return F.transform(polygon, lambda ring, i: F.when((ring_area(ring) > 0) == (i == 0), F.reverse(ring)).otherwise(ring))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    n = F.size(ring)
    places = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))

    def crosses(i: Column) -> Column:
        ax, ay = F.get(F.get(ring, i), F.lit(0)), F.get(F.get(ring, i), F.lit(1))
        bx, by = F.get(F.get(ring, i + 1), F.lit(0)), F.get(F.get(ring, i + 1), F.lit(1))
        at = ax + (y - ay) * F.try_divide(bx - ax, by - ay)
        return ((ay > y) != (by > y)) & (x < at)

    return F.aggregate(places, F.lit(False), lambda a, i: a != F.coalesce(crosses(i), F.lit(False)))


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Inside the outer ring and outside all holes: an odd number of rings around the point."""
    return F.aggregate(polygon, F.lit(False), lambda a, ring: a != in_ring(ring, x, y))


def locate(points: DataFrame, polygons: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat", size: float = 1.0) -> DataFrame:
    """Each point with the first polygon (by ``ordinal``) that holds it; points outside all are left out.

    polygons: polygon_id, ordinal, polygon (array of rings of [x, y]). Both sides are dealt to grid
    cells, polygons to those that their box touches, so points meet only polygons nearby.
    """
    x, y = F.col(lon), F.col(lat)
    points = points.withColumns({"_x": F.floor(x / size), "_y": F.floor(y / size)})
    outer = F.get("polygon", F.lit(0))
    xs, ys = F.transform(outer, lambda p: F.get(p, F.lit(0))), F.transform(outer, lambda p: F.get(p, F.lit(1)))
    cells = polygons.select("polygon_id", "ordinal", "polygon", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    cells = cells.withColumn("_x", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
    cells = cells.withColumn("_y", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    met = points.join(cells, ["_x", "_y"]).where((x >= F.col("x0")) & (x <= F.col("x1")) & (y >= F.col("y0")) & (y <= F.col("y1")))
    held = met.where(in_polygon(F.col("polygon"), x, y)).drop("polygon", "_x", "_y", "x0", "x1", "y0", "y1")
    first = Window.partitionBy(*keys).orderBy("ordinal", "polygon_id")
    return held.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def feature_polygons(features: DataFrame, key: str = "adcode") -> DataFrame:
    """polygon_id, ordinal, polygon of ``tables.read_features``: one row per polygon, so several of a multipolygon."""
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    text, single = F.col("geometry.coordinates"), F.col("geometry.type") == "Polygon"
    parts = F.when(single, F.array(F.from_json(text, one))).otherwise(F.from_json(text, many))
    rows = features.where(F.col("geometry.type").isin("Polygon", "MultiPolygon"))
    return rows.select(F.col(key).cast("string").alias("polygon_id"), F.posexplode(parts).alias("ordinal", "polygon")).where("polygon is not null")


def outline(polygons: DataFrame) -> tuple[float, float, float, float] | None:
    """West, south, east and north of all polygons together."""
    points = polygons.select(F.explode(F.get("polygon", F.lit(0))).alias("p"))
    x, y = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    r = points.agg(F.min(x).alias("w"), F.min(y).alias("s"), F.max(x).alias("e"), F.max(y).alias("n")).first()
    return None if r["w"] is None else (r["w"], r["s"], r["e"], r["n"])


def zonal_sum(pixels: DataFrame, polygons: DataFrame, keys: list[str], value: str, **how) -> DataFrame:
    """Sum, mean and number of the pixels in each polygon."""
    inside = locate(pixels, polygons, keys, **how)
    return inside.groupBy("polygon_id").agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(value).alias("pixels"))


def unit_totals(located: DataFrame, value: str, labels: str, n: int = 3) -> DataFrame:
    """Per polygon and year: the sum and the first n sorted distinct labels joined by ;."""
    return located.groupBy("polygon_id", "year").agg(F.sum(value).alias(value), F.array_join(F.slice(F.array_sort(F.collect_set(labels)), 1, n), ";").alias(labels))


def suffix_counts(rows: DataFrame, keys: list[str], name: str, classes: dict[str, str]) -> DataFrame:
    """Names counted by the class of their ending, one column each and a total."""
    label = F.lit("other")
    for cls, pattern in reversed(classes.items()):
        label = F.when(F.col(name).rlike(pattern), cls).otherwise(label)
    names = [*classes, "other"]
    wide = rows.withColumn("_c", label).groupBy(*keys).pivot("_c", names).count().na.fill(0, names)
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return wide.withColumn("total", total)
