"""Pages, classes and the graph around a keyword, on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import archive, classes, endpoints, records, subgraph
from cadastra.operators.relations import NAMES, ORDER, RELATION_TYPES
from cadastra.plans.domain_queries import _AREAS, q_static_nodes
from cadastra.sources.tables import load

#: Line states and the relation types that stand for them here.
STATES = {"AF": "REVOKE_ADMIN", "RF": "ESTABLISH_ADMIN", "NF": "RENAME_ADMIN", "NO": "TRANSFER_ADMIN"}
SOURCE_IDS = [
    "nbs_yearbook_province_admin_2011", "carried_forward_from_2023", "statistical_forecast_from_counts", "statistical_forecast_from_2009_2023_counts_with_external_regressors", "", "other",
]


def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records whose relation types are those of their lines' states."""
    li = load(spark, sf_dir, "lineitem").withColumn("state", F.concat("l_returnflag", "l_linestatus"))
    into = F.create_map(*(F.lit(x) for p in STATES.items() for x in p))
    per = li.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_set(into[F.col("state")]).alias("_t"))
    ids = F.filter(F.array(*map(F.lit, ORDER)), lambda t: F.array_contains("_t", t))
    names = F.transform(ids, lambda t: F.element_at(F.create_map(*(F.lit(x) for p in NAMES.items() for x in p)), t))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("record_text"))
    return per.select("record_id", F.array_join(ids, " / ").alias("relation_type_ids"), F.array_join(names, " / ").alias("type_label")).join(o, "record_id")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, their affiliations, and customers' relations to nations over the years of their orders."""
    nodes = q_static_nodes(spark, sf_dir)
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("year"))
    dynamic = c.join(o, "c_custkey").select(
        F.col("c_name").alias("subject"), F.lit("隶属于").alias("predicate"), F.col("n_name").alias("object"), F.col("c_custkey").cast("string").alias("record_id"), "year", F.concat_ws(" ", "c_name", "n_name").alias("evidence_text")
    )
    return nodes, records.static_affiliations(nodes, "1"), dynamic


def q_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive with what the documents show: pattern counts, and no verbs."""
    docs = load(spark, sf_dir, "documents").select(F.col("text").alias("sentence"))
    verbs = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("verb")).agg(F.count("*").alias("count"))
    got = archive.archive_with_evidence(docs, verbs)
    return got.select("relation_type_id", "schema_order", F.size("triggers").alias("triggers"), "trigger_count", "evidence_sentence_count", F.length("notes").alias("remark_chars"))


def q_six_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classes.six_class_records(change_records(spark, sf_dir))
    return got.select("record_id", F.array_join("label_set", "|").alias("classes"))


def q_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = change_records(spark, sf_dir).groupBy("type_label").agg(F.count("*").alias("value"))
    return classes.type_distribution(per, "semantic")


def q_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = change_records(spark, sf_dir).groupBy("type_label").agg(F.count("*").alias("value"))
    return classes.type_distribution(per)


def q_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the class that a type's name belongs to."""
    return classes.with_type(change_records(spark, sf_dir), "撤销建制", "semantic").select("record_id", "type_label")


def q_class_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class and side how many records there are and how many the balanced sample has."""
    split = classes.six_class_split(change_records(spark, sf_dir), 25)
    return split.select("is_test", "is_sample", F.explode("label_set").alias("class")).groupBy("class").agg(F.count("*").alias("records"), F.least(F.count_if("is_sample"), F.lit(25)).alias("samples"))


def q_area_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, up, _ = parts(spark, sf_dir)
    return classes.area_rows(nodes, up)


def q_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, up, _ = parts(spark, sf_dir)
    return endpoints.provinces(nodes, up)


def q_children_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, up, _ = parts(spark, sf_dir)
    return endpoints.children(nodes, up, "130000", "city,county")


def q_forecast_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = change_records(spark, sf_dir).withColumns({"classification_confidence": F.lit(0.9), "classification_rule": F.lit("rule")})
    got = endpoints.forecast_year(rec, rec, 1997)
    return got["events"].join(got["classifications"].drop("year"), "event_id")


def q_graph_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.graph_node(*parts(spark, sf_dir), "NATION_3")["relations"]


def q_graph_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.graph_node(*parts(spark, sf_dir), "NATION_3")["area"]


def q_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subgraph.keyword_subgraph(*parts(spark, sf_dir), "NATION_3")[0]


def q_subgraph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subgraph.keyword_subgraph(*parts(spark, sf_dir), "NATION_3")[1]


def q_area_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_static_nodes(spark, sf_dir).select("node_id", classes.area_text(F.col("full_path")).alias("plain"))


def q_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' counts under six ids of sources, as a panel shows them."""
    ids = F.array(*map(F.lit, SOURCE_IDS))
    rows = load(spark, sf_dir, "supplier").select(F.element_at(ids, (F.col("s_suppkey") % len(SOURCE_IDS) + 1).cast("int")).alias("source"))
    return rows.groupBy(classes.township_source(F.col("source")).alias("source_label")).agg(F.count("*").alias("count"))


_IDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())
_CLASS = "CASE t WHEN 'REVOKE_ADMIN' THEN '建制变更' WHEN 'ESTABLISH_ADMIN' THEN '建制变更' WHEN 'RENAME_ADMIN' THEN '名称变更' ELSE '区域划转' END"
_NAME = "CASE t WHEN 'REVOKE_ADMIN' THEN '撤销建制' WHEN 'ESTABLISH_ADMIN' THEN '设立建制' WHEN 'RENAME_ADMIN' THEN '名称变更' ELSE '区域划转' END"
_PLACE = "CASE t WHEN 'REVOKE_ADMIN' THEN 1 WHEN 'ESTABLISH_ADMIN' THEN 2 WHEN 'RENAME_ADMIN' THEN 3 ELSE 4 END"
_RECORDS = f"""
st AS (SELECT DISTINCT l_orderkey AS record_id, CASE l_returnflag || l_linestatus {_IDS} END AS t FROM lineitem),
rec AS (SELECT record_id, coalesce(string_agg({_NAME}, ' / ' ORDER BY {_PLACE}) FILTER (t IS NOT NULL), '') AS type_label FROM st GROUP BY 1),
cls AS (SELECT DISTINCT record_id, {_CLASS} AS class FROM st WHERE t IS NOT NULL),
ord AS (SELECT rec.*, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS record_text FROM rec JOIN orders ON record_id = o_orderkey)
"""
_CLASS_PLACE = "CASE class WHEN '建制变更' THEN 1 WHEN '名称变更' THEN 2 ELSE 4 END"
_SHOWN = f"""WITH {_AREAS}, shown AS (SELECT n.admin_code AS code, n.admin_name AS name, CASE n.admin_level WHEN 'prefecture' THEN 'city' WHEN 'township' THEN 'town' ELSE n.admin_level END AS level,
 CASE n.admin_level WHEN 'country' THEN '国家' WHEN 'province' THEN '省级' WHEN 'prefecture' THEN '地市级' WHEN 'county' THEN '县区级' ELSE '乡镇街道级' END AS level_name, p.admin_code AS parent_code, n.full_path, n.source_table
 FROM nodes n LEFT JOIN aff ON n.node_id = subject_node_id LEFT JOIN nodes p ON p.node_id = object_node_id)"""
_DYNAMIC = "dyn AS (SELECT c_name AS subject, '隶属于' AS relation, n_name AS object, CAST(c_custkey AS VARCHAR) AS record_id, y AS year, c_name || ' ' || n_name AS evidence_text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS y FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
_LABEL = """CASE source WHEN 'nbs_yearbook_province_admin_2011' THEN '国家统计局《中国统计年鉴》1-1 全国行政区划省级表（2011年底）' WHEN 'carried_forward_from_2023' THEN '现势估计：沿用最新统计用区划代码省级统计值'
 WHEN 'statistical_forecast_from_counts' THEN '统计预测：基于历史省级数量序列的阻尼 Huber 趋势' WHEN 'statistical_forecast_from_2009_2023_counts_with_external_regressors' THEN '统计预测：历史数量趋势 + 外部回归因子' WHEN '' THEN '未标注来源' ELSE source END"""

QUERIES = {
    "relation_archive": q_archive,
    "six_class_labels": q_six_class,
    "class_distribution": q_class_distribution,
    "type_distribution": q_type_distribution,
    "class_filter": q_class_filter,
    "class_samples": q_class_samples,
    "area_rows": q_area_rows,
    "page_provinces": q_provinces,
    "page_children": q_children_page,
    "page_forecast_year": q_forecast_year,
    "page_graph_node": q_graph_node,
    "page_graph_area": q_graph_area,
    "subgraph_nodes": q_subgraph_nodes,
    "subgraph_links": q_subgraph_links,
    "area_text": q_area_text,
    "township_sources": q_sources,
}
_TYPES = ", ".join(
    f"('{i}', {k}, {len(triggers)}, '{pattern}', {len(notes)})"
    for k, ((i, _, _, _, triggers, _, pattern), (_, _, _, _, _, notes)) in enumerate(zip(RELATION_TYPES, archive.HINTS, strict=True), 1)
)
ORACLES = {
    "relation_archive": f"""WITH t(relation_type_id, schema_order, triggers, pattern, remark_chars) AS (VALUES {_TYPES})
SELECT relation_type_id, schema_order, triggers, CAST(0 AS BIGINT) AS trigger_count, (SELECT count(*) FROM documents WHERE regexp_matches(text, pattern)) AS evidence_sentence_count, remark_chars FROM t""",
    "six_class_labels": f"WITH {_RECORDS} SELECT rec.record_id, coalesce(string_agg(class, '|' ORDER BY {_CLASS_PLACE}), '') AS classes FROM rec JOIN orders ON record_id = o_orderkey LEFT JOIN cls USING (record_id) GROUP BY 1",
    "class_distribution": f"WITH {_RECORDS}, o AS (SELECT unnest({list(classes.CLASSES)}) AS type) SELECT type, count(cls.record_id) AS value FROM o LEFT JOIN (cls JOIN ord USING (record_id)) ON class = type GROUP BY 1",
    "type_distribution": f"WITH {_RECORDS} SELECT {_NAME} AS type, count(*) AS value FROM st JOIN ord USING (record_id) WHERE t IS NOT NULL GROUP BY 1",
    "class_filter": f"WITH {_RECORDS} SELECT record_id, type_label FROM ord WHERE record_id IN (SELECT record_id FROM cls WHERE class = '建制变更')",
    "class_samples": f"WITH {_RECORDS} SELECT class, count(*) AS records, CAST(25 AS BIGINT) AS samples FROM cls JOIN ord USING (record_id) GROUP BY 1",
    "area_rows": f"{_SHOWN} SELECT * FROM shown",
    "page_provinces": f"{_SHOWN} SELECT * FROM shown WHERE level = 'province'",
    "page_children": f"{_SHOWN} SELECT * FROM shown WHERE parent_code = '130000' AND level IN ('city', 'county')",
    "page_forecast_year": f"WITH {_RECORDS} SELECT record_id AS event_id, year, type_label AS title, record_text AS content, type_label AS change_type, 0.9::DOUBLE AS confidence, 'rule' AS evidence FROM ord WHERE year = 1997",
    "page_graph_node": f"WITH {_DYNAMIC} SELECT * FROM dyn WHERE contains(evidence_text, 'NATION_3') ORDER BY year DESC, record_id DESC, subject, relation, object LIMIT 50",
    "page_graph_area": f"{_SHOWN} SELECT * FROM shown WHERE name = 'NATION_3'",
    "area_text": f"WITH {_AREAS} SELECT node_id, replace(regexp_replace(full_path, '[/ \\t\\n\\r]', '', 'g'), '中国', '') AS plain FROM nodes",
    "township_sources": f"WITH s AS (SELECT {SOURCE_IDS}[s_suppkey % {len(SOURCE_IDS)} + 1] AS source FROM supplier) SELECT {_LABEL} AS source_label, count(*) AS count FROM s GROUP BY 1",
}
