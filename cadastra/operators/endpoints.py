"""What a page of the dashboard shows, one function per page: named tables, ready to be written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators import classes, forecast, graph, serving, subgraph


def overview(nodes: DataFrame, records: DataFrame, entities: DataFrame, dynamic: DataFrame, affiliations: DataFrame, labels: DataFrame, forecasts: DataFrame, view: str = "detail") -> dict[str, DataFrame]:
    """Row counts, units by level, and records by type or class."""
    counted = {"区划编码": nodes, "变更记录": records, "NER实体": entities, "关系三元组": dynamic, "静态隶属边": affiliations, "分类记录": labels.select("record_id").distinct(), "预测年份": forecasts}
    levels = nodes.groupBy(classes.level_name(F.col("admin_level")).alias("level_name")).agg(F.count("*").alias("value"))
    per = labels.groupBy("type_label").agg(F.countDistinct("record_id").alias("value"))
    return {"counts": serving.overview(counted), "levels": levels, "types": classes.type_distribution(per, view)}


def provinces(nodes: DataFrame, affiliations: DataFrame) -> DataFrame:
    return classes.area_rows(nodes, affiliations).where("level = 'province'").orderBy("code")


def children(nodes: DataFrame, affiliations: DataFrame, code: str, levels: str = "") -> DataFrame:
    """Units right below one, of the levels of a comma list or of all."""
    wanted = classes.level_set(levels)
    shown = classes.area_rows(nodes, affiliations).where(F.col("parent_code") == code)
    return (shown.where(F.col("level").isin([classes.PAGE_LEVELS.get(x, x) for x in wanted])) if wanted else shown).orderBy("code")


def relations(dynamic: DataFrame, keyword: str = "", wanted: str = "", view: str = "detail", year: int | None = None, limit: int = 0) -> dict[str, DataFrame]:
    """Relations by keyword, type or class, and year, with plain ends, and their counts by type or class."""
    rows = dynamic.where(serving.where_all(year=year) & serving.holds(keyword, ["subject", "object", "evidence_text"]) & (F.trim("subject") != "") & (F.trim("object") != ""))
    rows = classes.with_type(rows, wanted, view)
    rows = rows.withColumn("classes", classes.classes_of(classes.relation_ids(F.col("source_relation_type"), F.col("type_label"))))
    per = rows.groupBy("type_label").agg(F.count("*").alias("value"))
    return {"relations": serving.limited(rows, ["year", "subject", "predicate", "object"], limit), "types": classes.type_distribution(per, view)}


def classifications(labels: DataFrame, evaluation: DataFrame, matrix: DataFrame, view: str = "detail", wanted: str = "", keyword: str = "", limit: int = 0) -> dict[str, DataFrame]:
    """Classified records by type or class and keyword, their distribution, and the classifier's scores."""
    rows = classes.with_type(labels.where(serving.holds(keyword, ["record_text"])), wanted, view)
    per = labels.groupBy("type_label").agg(F.countDistinct("record_id").alias("value"))
    return {"records": serving.limited(rows, ["record_id", "type_id"], limit), "types": classes.type_distribution(per, view), "evaluation": evaluation.limit(1), "confusion": matrix}


def forecast_page(history: DataFrame, forecasts: DataFrame, metrics: DataFrame, target: str) -> dict[str, DataFrame]:
    """A target's observed and forecast years, the models' errors, and all targets."""
    own = lambda df: df.where(F.col("target") == target)
    series = serving.history_and_forecast(own(history), own(forecasts)).orderBy("year")
    return {"series": series, "metrics": own(metrics), "targets": history.select("target").distinct().orderBy("target")}


def forecast_year(records: DataFrame, labels: DataFrame, year: int) -> dict[str, DataFrame]:
    """What happened in a year: its records, and how they are classified."""
    events = records.where(F.col("year") == year).select(F.col("record_id").alias("event_id"), "year", F.col("type_label").alias("title"), F.col("record_text").alias("content"))
    found = labels.where(F.col("year") == year).select(
        F.col("record_id").alias("event_id"), "year", F.col("type_label").alias("change_type"), F.col("classification_confidence").alias("confidence"), F.col("classification_rule").alias("evidence")
    )
    return {"events": events.orderBy("event_id"), "classifications": found.orderBy("event_id", "change_type")}


def rural(panel: DataFrame, national: DataFrame, province: str) -> dict[str, DataFrame]:
    """Township counts of a province and the country with where they come from, villages, and all provinces."""
    named = panel.withColumn("source_label", classes.township_source(F.col("source_township_street_count")))
    names = panel.where("coalesce(province, '') != ''").select("province").distinct()
    villages = forecast.census_curve(panel.sparkSession)
    return {"provinces": names.orderBy("province"), "province_series": named.where(F.col("province") == province).orderBy("year"), "national": national.orderBy("year"), "natural": villages.orderBy("year")}


def graph_node(nodes: DataFrame, affiliations: DataFrame, dynamic: DataFrame, name: str, limit: int = 50) -> dict[str, DataFrame]:
    """The unit that a name stands for, and the relations that name it."""
    one = nodes.sparkSession.createDataFrame([(name,)], "name string")
    code = graph.resolve(nodes, "admin_name", "full_path", "admin_code", one).select("code")
    area = classes.area_rows(nodes, affiliations).join(F.broadcast(code), "code")  # one row at most
    return {"area": area, "relations": subgraph.related(dynamic, name, limit)}


def graph_search(nodes: DataFrame, affiliations: DataFrame, dynamic: DataFrame, keyword: str, limit: int = 140) -> dict[str, DataFrame]:
    found, links = subgraph.keyword_subgraph(nodes, affiliations, dynamic, keyword, limit=limit)
    return {"nodes": found, "links": links}
