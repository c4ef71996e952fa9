"""Commands over files: ``python -m cadastra.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import csv
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import atlas, forecast, panels, spatial
from cadastra.sources import raster, sinks, tables, web

LEVELS = ["province", "city", "county", "township", "village"]


def session() -> SparkSession:
    return SparkSession.builder.appName("cadastra").getOrCreate()


def metrics_of(args: argparse.Namespace) -> list[str]:
    """The metrics named on the command line, else those of the configuration."""
    return args.metrics or sorted(atlas.read_config(args.config).get("metrics", {}))


def read_panel(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """A panel's CSV with numbers where numbers belong; values without a status are observed."""
    df = tables.read_csv(spark, path, required=["unit_id", "year"])
    df = tables.numbers(df, [c for c in ("lon", "lat", *metrics) if c in df.columns])
    for m in (m for m in metrics if m in df.columns):
        status = F.col(f"status_{m}") if f"status_{m}" in df.columns else F.lit(None).cast("string")
        df = df.withColumn(f"status_{m}", F.when(F.col(m).isNotNull(), F.coalesce(status, F.lit("observed"))).otherwise(status))
    return df.withColumn("year", F.col("year").try_cast("int"))


def make_template(args: argparse.Namespace) -> None:
    """A panel's CSV with its header only."""
    out = Path(args.output)
    out.parent.mkdir(parents=True, exist_ok=True)
    with open(out, "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerow(atlas.panel_schema(metrics_of(args)).names)


def validate(args: argparse.Namespace) -> DataFrame:
    """What is wrong in a panel; raises SystemExit with errors, or warnings of missing sources unless allowed."""
    metrics = metrics_of(args)
    found = panels.validate_panel(read_panel(session(), args.input, metrics), metrics, ["unit_id", "year", *metrics])
    stop = F.col("level") == "error"
    if not args.allow_missing_source:
        stop |= F.col("check") == "no_source"
    bad = found.where(stop).orderBy("check", "metric").collect()  # a row per check and metric
    if bad:
        raise SystemExit("\n".join(f"{r['level']}: {r['check']} {r['metric']} {r['count']}" for r in bad))
    return found


def run(args: argparse.Namespace) -> None:
    """Comparison of years, scores and forecasts of a panel, as tables in a folder."""
    spark, metrics = session(), metrics_of(args)
    config = atlas.read_config(args.config) if Path(args.config).exists() else {}
    validate(args)
    df = read_panel(spark, args.input, metrics)
    ends = df.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    first, last = args.start_year or ends["a"], args.baseline_year or ends["b"]
    static = [c for c in ("unit_name", "level", "province", "city", "county", "lon", "lat") if c in df.columns]
    observed = panels.expand_panel(df, metrics, first, last, static)
    begin = args.forecast_start_year or last + 1
    known = observed if args.use_interpolated_for_forecast else df
    ahead = forecast.forecast_panel(known, metrics, begin, args.forecast_end_year or begin + 4)
    weights = atlas.metric_weights(config) if config.get("metrics") else {m: 1 / len(metrics) for m in metrics}
    indexed = panels.indices(panels.yearly_changes(observed, metrics), {m: w for m, w in weights.items() if m in metrics})
    frames = {"panel": observed, "indices": indexed, "summary": panels.national_summary(indexed, metrics), "forecast": ahead}
    sinks.write_tables(frames, args.output_dir)
    sinks.write_json(sinks.run_metadata({"panel": args.input}, frames, {"metrics": metrics, "first": first, "last": last}), f"{args.output_dir}/metadata.json")


def zonal_raster(args: argparse.Namespace) -> None:
    """A raster's sum, mean and pixel count in each unit's polygon."""
    spark = session()
    polygons = spatial.feature_polygons(tables.read_features(spark, args.units_geojson), args.unit_id_column)
    pixels = raster.read_pixels(spark, args.raster, spatial.outline(polygons), positive=False)
    rows = spatial.zonal_sum(pixels, polygons, ["lon", "lat"], "value")
    value = F.col("mean" if "mean" in args.stats else args.stats[0])
    out = rows.select(F.col("polygon_id").alias("unit_id"), F.lit(args.year).alias("year"), value.alias(args.metric), F.lit(args.source_id).alias(f"source_{args.metric}"))
    sinks.write_csv(out, args.output, mark=True)


def build_admin(args: argparse.Namespace) -> None:
    """One table of units from a folder of code tables by level."""
    spark = session()
    levels = [(level, tables.read_csv(spark, str(p))) for level in LEVELS if (p := Path(args.raw_dir) / f"{level}.csv").exists()]
    sinks.write_csv(tables.admin_units(levels), args.output, mark=True)


def fetch(args: argparse.Namespace) -> list[Path]:
    """Files from URLs into a folder, those that are there stay; with --extract the rasters in archives."""
    files = [web.fetch_once(u, f"{args.output_dir}/{u.rsplit('/', 1)[-1]}", args.least, args.overwrite) for u in args.urls]
    return [web.extract_first(str(f), ".tif", args.output_dir) if args.extract and f.suffix == ".zip" else f for f in files]


def aggregate_ghsl(args: argparse.Namespace) -> None:
    """A population raster summed in grid cells whose centre lies in a boundary."""
    spark = session()
    tif = args.tif or str(web.extract_first(args.zip, ".tif", str(Path(args.output).parent)))
    polygons = spatial.feature_polygons(tables.read_features(spark, args.boundary_geojson))
    cells = spatial.grid_sum(raster.read_pixels(spark, tif, spatial.outline(polygons)), "lon", "lat", "value", args.resolution).withColumnRenamed("value", "population")
    sinks.write_csv(atlas.cell_panel(cells, polygons, args.year, args.resolution, "population"), args.output, mark=True)


def nowcast_population(args: argparse.Namespace) -> None:
    """A panel's rows of one year again for a later one."""
    df = tables.read_csv(session(), args.input, required=["unit_id", "year"]).withColumn("year", F.col("year").cast("int")).where(F.col("year") == args.source_year)
    df = df if "status_population" in df.columns else df.withColumn("status_population", F.lit("observed"))
    sinks.write_csv(panels.carry_forward(df, ["unit_id"], [args.target_year], "status_population", "nowcast"), args.output, mark=True)


def quantity_atlas(args: argparse.Namespace) -> None:
    """Township counts by province and for the country, with their forecast, as tables in a folder."""
    spark = session()
    streets = tables.read_yearly_csv(spark, f"{args.streets_dir}/*.csv", "code string, name string, provinceCode string, cityCode string, areaCode string")
    features = tables.read_features(spark, args.boundary_geojson)
    centres = features.select(F.col("adcode").alias("unit_id"), F.col("name").alias("province"), "lon", "lat")
    panel = atlas.count_panel(streets, centres, args.baseline_year)
    frames = {
        "province": atlas.with_forecast(panel, args.forecast_start_year, args.forecast_end_year),
        "national": atlas.national_series(spark, args.baseline_year, args.forecast_start_year, args.forecast_end_year),
        "natural_village": forecast.census_curve(spark, last=args.forecast_end_year),
    }
    sinks.write_tables(frames, args.output_dir)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cadastra")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, do, *options: tuple, panel: bool = False) -> None:
        p = sub.add_parser(name, help=(do.__doc__ or "").split("\n")[0])
        p.set_defaults(do=do)
        if panel:
            p.add_argument("--config", default="config.toml")
            p.add_argument("--metrics", nargs="*")
        for flag, how in options:
            p.add_argument(flag, **how)

    need, number, switch = {"required": True}, {"type": int}, {"action": "store_true"}
    command("make-template", make_template, ("--output", need), panel=True)
    command("validate", validate, ("--input", need), ("--allow-missing-source", switch), panel=True)
    command(
        "run", run, ("--input", need), ("--output-dir", need), ("--allow-missing-source", switch), ("--use-interpolated-for-forecast", switch),
        *((f"--{x}-year", number) for x in ("start", "baseline", "forecast-start", "forecast-end")), panel=True,
    )
    command(
        "zonal-raster", zonal_raster, *((f"--{x}", need) for x in ("units-geojson", "raster", "output", "metric", "source-id")), ("--year", {"type": int, "required": True}),
        ("--unit-id-column", {"default": "adcode"}), ("--stats", {"nargs": "+", "default": ["mean"]}),
    )
    command("build-admin", build_admin, ("--raw-dir", need), ("--output", need))
    for name in ("fetch-admin", "fetch-ghsl"):
        command(name, fetch, ("--urls", {"nargs": "+", "required": True}), ("--output-dir", need), ("--overwrite", switch), ("--extract", switch), ("--least", {"type": int, "default": 1}))
    command(
        "aggregate-ghsl", aggregate_ghsl, ("--tif", {}), ("--zip", {}), ("--boundary-geojson", need), ("--output", need), ("--year", {"type": int, "required": True}),
        ("--resolution", {"type": float, "default": 0.5}),
    )
    command("nowcast-population", nowcast_population, ("--input", need), ("--output", need), ("--source-year", {"type": int, "required": True}), ("--target-year", {"type": int, "required": True}))
    years = {"baseline": 2026, "forecast-start": 2027, "forecast-end": 2035}
    command("quantity-atlas", quantity_atlas, ("--streets-dir", need), ("--boundary-geojson", need), ("--output-dir", need), *((f"--{x}-year", {"type": int, "default": y}) for x, y in years.items()))
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.do(args)


if __name__ == "__main__":
    main()
