"""Writing results: CSV and JSON at the edge, tables with a catalogue, Cypher and Markdown text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, separator: str = " / ", mark: bool = False) -> None:
    """CSV with a header; arrays become delimited strings, which CSV can hold. As many files as
    partitions: gathering them into one is left to who reads them. With ``mark`` every file begins
    with a byte order mark, in its header's first name, as spreadsheets want it."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    flat = [F.array_join(c, separator).alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_tables(frames: dict[str, DataFrame], folder: str, partition: dict[str, str] | None = None) -> None:
    """One Parquet table per name, by a partition column where one is named: what an index would
    be for, pruning does."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        if partition and name in partition:
            writer = writer.partitionBy(partition[name])
        writer.parquet(f"{folder}/{name}")


def catalogue(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """table_name, row_count, column_count, size_bytes, modified of written tables."""

    def one(name: str) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}")
        width = len(df.columns)
        per = df.groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("m"))
        per = per.agg(F.count("*").alias("n"))
        return per.agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.lit(width).alias("column_count"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("size_bytes"),
            F.max("m").alias("modified"),
        )

    return reduce(DataFrame.unionByName, map(one, names))


def needs_rebuild(written: DataFrame, sources: DataFrame) -> DataFrame:
    """table_name, stale: tables that aren't written, or that a source is newer than.
    sources: table_name, modified."""
    newest = sources.groupBy("table_name").agg(F.max("modified").alias("source_modified"))
    joined = newest.join(written.select("table_name", "modified"), "table_name", "left")
    stale = F.col("modified").isNull() | (F.col("source_modified") > F.col("modified"))
    return joined.select("table_name", stale.alias("stale"))


def output_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """name, rows and columns of each result."""
    one = lambda k, df: df.agg(F.lit(k).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
    return reduce(DataFrame.unionByName, (one(k, df) for k, df in frames.items()))


def write_json(document: object, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)


def run_metadata(inputs: dict[str, str], frames: dict[str, DataFrame], parameters: dict[str, object]) -> dict:
    """What a run read, with which parameters, and the rows and columns of each result."""
    made = {r["name"]: {"rows": r["rows"], "columns": r["columns"]} for r in output_summary(frames).collect()}  # a row per result
    return {"inputs": inputs, "parameters": parameters, "outputs": made}


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a pipe table; a last line says so where there are more than ``limit`` rows."""
    found = df.limit(limit + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *found[:limit]]
    more = [f"\nThe first {limit} rows."] if len(found) > limit else []
    return "\n".join(["| " + " | ".join(map(cell, r)) + " |" for r in rows] + more)


def cypher_script(nodes_file: str, edges_file: str, families: list[str]) -> str:
    """Statements that load node and edge CSV files into a property graph, one relation per family."""
    load = "LOAD CSV WITH HEADERS FROM 'file:///{}' AS row"
    out = ["CREATE CONSTRAINT node_key IF NOT EXISTS FOR (n:Entity) REQUIRE n.node_id IS UNIQUE;"]
    out.append(f"{load.format(nodes_file)}\nMERGE (n:Entity {{node_id: row.node_id}})\nSET n += row;")
    for family in families:
        out.append(
            f"{load.format(edges_file)}\nWITH row WHERE row.edge_type = '{family}'\n"
            "MATCH (a:Entity {node_id: row.start_id}), (b:Entity {node_id: row.end_id})\n"
            f"MERGE (a)-[r:{family} {{edge_id: row.edge_id}}]->(b)\nSET r += row;"
        )
    return "\n\n".join(out) + "\n"
