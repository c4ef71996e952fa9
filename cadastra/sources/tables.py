"""Reading tables and files, and the guards on what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.operators import notices


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def schema(**fields: str) -> str:
    """Explicit schema from names and type names; nothing is inferred, so codes keep their zeros."""
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())


SOURCE_LINES = schema(source_file="string", year="int", line_no="int", raw_line="string")
SENTENCES = schema(sentence_id="string", source_file="string", year="int", line_no="int", item_no="string", sentence="string")
ADMIN_CODES = schema(code="string", name="string")
MACRO = schema(year="int", gdp_current_lcu="double", population_total="double", gdp_per_capita_lcu="double")
RULE_LABELS = schema(record_id="string", year="int", item_no="string", record_text="string", relation_type_ids="string")


def read_csv(spark: SparkSession, path: str, fields: str | None = None, required: list[str] | None = None) -> DataFrame:
    """CSV with a header, with an explicit schema or all strings; a byte order mark is dropped."""
    if fields is None:
        df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    else:
        df = spark.read.schema(fields).option("header", True).option("enforceSchema", True).csv(path)
    return require_columns(df, required or [])


def read_optional(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """``read_csv`` where the path exists, else an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return read_csv(spark, path, fields) if there is not None and len(there) else spark.createDataFrame([], fields)


def read_notices(spark: SparkSession, folder: str, limit_files: int = 0) -> DataFrame:
    """source_lines of all .txt files: one task reads one file, lines are numbered from 1."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    files = files.select(F.col("_metadata.file_name").alias("source_file"), "value")
    if limit_files > 0:
        first = files.select("source_file").orderBy("source_file").limit(limit_files)
        files = files.join(F.broadcast(first), "source_file", "left_semi")
    lines = files.select("source_file", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("i", "raw_line"), F.size(F.split("value", r"\r\n|\r|\n")).alias("n"))
    lines = lines.where((F.col("raw_line") != "") | (F.col("i") < F.col("n") - 1))
    year = F.nullif(F.regexp_extract("source_file", r"^(\d{4})_", 1), F.lit("")).cast("int")
    return lines.select("source_file", year.alias("year"), (F.col("i") + 1).alias("line_no"), "raw_line")


def read_sentences(spark: SparkSession, mode: str, path: str, limit_files: int = 0, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sentences with ids and the lines they come from (empty for ``csv``), by the kind of input: a folder
    of notices (``source``) or a table of sentences (``csv``). Limits of 0 mean all."""
    if mode == "csv":
        rows = read_csv(spark, path, SENTENCES)
        return (rows.orderBy("sentence_id").limit(limit) if limit > 0 else rows), spark.createDataFrame([], SOURCE_LINES)
    if mode != "source":
        raise ValueError(f"input mode {mode}; there are source and csv")
    lines = read_notices(spark, path, limit_files)
    rows = notices.sentences(notices.parse_lines(lines), limit)
    return notices.dense_ids(rows, ["source_file", "line_no", "sentence_no"], "sentence_id", "S%06d"), lines


def read_yearly_csv(spark: SparkSession, glob: str, fields: str) -> DataFrame:
    """CSV files whose names end in _YYYY.csv, with that year as a column."""
    df = spark.read.schema(fields).option("header", True).csv(glob)
    return df.withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{4})", 1).cast("int"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """adcode, name, lon, lat (centroid, else centre) and geometry of a GeoJSON file's features."""
    point = "array<double>"
    props = f"struct<adcode:string,name:string,centroid:{point},center:{point}>"
    fields = f"features array<struct<properties:{props},geometry:struct<type:string,coordinates:string>>>"
    df = spark.read.schema(fields).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.coalesce("f.properties.centroid", "f.properties.center")
    return df.select(
        F.col("f.properties.adcode").alias("adcode"), F.col("f.properties.name").alias("name"), F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), "f.geometry"
    )


def read_indicator_json(payload: DataFrame, column: str, name: str) -> DataFrame:
    """(year, value) rows of indicator payloads: JSON arrays whose second item lists {date, value}."""
    rows = F.from_json(F.get_json_object(column, "$[1]"), "array<struct<date:string,value:double>>")
    return payload.select(F.inline(rows)).select(F.col("date").cast("int").alias("year"), F.col("value").alias(name))


def macro_table(spark: SparkSession, indicators: list[DataFrame], first: int, last: int, gdp: str = "gdp_current_lcu", people: str = "population_total") -> DataFrame:
    """Indicators on a dense range of years, with GDP per head where both are known."""
    out = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    for df in indicators:
        out = out.join(F.broadcast(df.groupBy("year").agg(*(F.first(c, True).alias(c) for c in df.columns if c != "year"))), "year", "left")
    return out.withColumn("gdp_per_capita_lcu", F.try_divide(gdp, people))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what isn't a number, and NaN, becomes null."""
    as_number = lambda c: F.col(c).cast("string").try_cast("double")
    return df.withColumns({c: F.when(F.isnan(as_number(c)), None).otherwise(as_number(c)) for c in columns})


def admin_units(levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """One table of units from code tables by level, each with its parents' names.

    levels: (level, table of code, name and the parents' codes as provinceCode, cityCode, areaCode,
    streetCode), from the top. Parents are joined from the levels above.
    """
    parents = ["provinceCode", "cityCode", "areaCode", "streetCode"]
    out, above = None, []
    for level, df in levels:
        rows = df.select("code", "name", *(c for c in parents if c in df.columns))
        kept = [F.col("code").alias("unit_id"), F.col("name").alias("unit_name"), F.lit(level).alias("level")]
        for parent, (name, table) in zip(parents, above, strict=False):
            if parent in rows.columns:
                look = table.select(F.col("code").alias(parent), F.col("name").alias(f"_{name}"))
                rows = rows.join(look, parent, "left")
                kept.append(F.col(f"_{name}").alias(name))
        kept.append(F.col("name").alias(level))
        rows = rows.select(*kept)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        above.append((level, df))
    return out


def unique_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order, where ``dropDuplicates`` would take any."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_k", first).where("_k = 1").drop("_k")
