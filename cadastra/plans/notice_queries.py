"""The notice pipeline from lines to graph.

The tables hold no notices, so one is made of every supplier: its file is its nation's, and its key
tells what the notice says. Without a folder of tables the functions take a few sample notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import entities, graph, notices, records, relations
from cadastra.operators.stages import settle
from cadastra.plans.sql import half_even
from cadastra.sources.tables import ADMIN_CODES, SOURCE_LINES, load

LINES = [
    ("1999_a.txt", 1999, 1, "1999年县级以上行政区划变更情况"),
    ("1999_a.txt", 1999, 2, "一、撤销北京市昌平县，设立北京市昌平区，以原昌平县的行政区域为昌平区的行政区域。昌平区人民政府驻城区镇。"),
    ("1999_a.txt", 1999, 3, "二、潞西市更名为芒市。"),
    ("1999_a.txt", 1999, 4, "三、将六安市寿县划归淮南市管辖。"),
    ("1999_a.txt", 1999, 5, "（1999年3月2日公布，民政部）"),
    ("1999_a.txt", 1999, 6, ""),
    ("2000_b.txt", 2000, 1, "（以行政区划变更公布时间为序）"),
    ("2000_b.txt", 2000, 2, "一、将宁冈县和县级井冈山市合并，组建新的县级井冈山市。共青城市由江西省直辖。"),
    ("2000_b.txt", 2000, 3, "二、汤旺县由伊春市管辖；将资阳市代管的县级简阳市改由成都市代管。"),
    ("2000_b.txt", 2000, 4, "三、龙湾区人民政府驻地由状元镇迁至永中镇。调整河北省廊坊市安次区的行政区划，增设廊坊市广阳区。"),
    ("2000_b.txt", 2000, 5, "四、撤销福建省莆田县。"),
    ("2000_b.txt", 2000, 6, "五、设立县级北屯市，辖3个街道。"),
]
CODES = [
    ("110000", "中国,北京市"), ("110114", "中国,北京市,昌平区"), ("350000", "中国,福建省"), ("350300", "中国,福建省,莆田市"), ("360000", "中国,江西省"),
    ("360800", "中国,江西省,吉安市"), ("360881", "中国,江西省,吉安市,井冈山市"), ("360400", "中国,江西省,九江市"), ("360482", "中国,江西省,九江市,共青城市"), ("340000", "中国,安徽省"),
    ("340400", "中国,安徽省,淮南市"), ("340422", "中国,安徽省,淮南市,寿县"), ("510000", "中国,四川省"), ("510100", "中国,四川省,成都市"), ("510185", "中国,四川省,成都市,简阳市"),
    ("512000", "中国,四川省,资阳市"), ("130000", "中国,河北省"), ("131000", "中国,河北省,廊坊市"), ("131002", "中国,河北省,廊坊市,安次区"), ("131003", "中国,河北省,廊坊市,广阳区"),
    ("230000", "中国,黑龙江省"), ("230700", "中国,黑龙江省,伊春市"), ("533103", "中国,云南省,芒市"), ("659005", "中国,新疆维吾尔自治区,北屯市"), ("330303", "中国,浙江省,温州市,龙湾区"),
]


DIGITS, STEMS, NUMERALS = "0123456789", "甲乙丙丁戊己庚辛壬癸", "〇一二三四五六七八九"


def _name(first: str, key: str, last: str) -> Column:
    return F.concat(F.lit(first), F.translate(F.col(key).cast("string"), DIGITS, STEMS), F.lit(last))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their own, their nation's and their region's names as units, and the notices' files."""
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    year = (2000 + F.col("n_nationkey") % 20).cast("int")
    return rows.select(
        F.col("s_suppkey").alias("k"), "n_nationkey", "n_regionkey", _name("安", "s_suppkey", "县").alias("c"), _name("安", "s_suppkey", "区").alias("d"),
        _name("庆", "n_nationkey", "市").alias("n"), _name("盛", "n_regionkey", "省").alias("r"), year.alias("year"), F.concat_ws("", year.cast("string"), F.lit("_"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("source_file"),
    )


def source_lines(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    if not sf_dir:
        return spark.createDataFrame(LINES, SOURCE_LINES)
    rows = told(spark, sf_dir)
    says = [
        F.concat(F.lit("撤销"), "c", F.lit("。")), F.concat(F.lit("设立"), "c", F.lit("。")), F.concat("c", F.lit("由"), "n", F.lit("管辖。")),
        F.concat(F.lit("将"), "c", F.lit("划归"), "n", F.lit("管辖。")), F.concat("c", F.lit("更名为"), "d", F.lit("。")),
    ]
    said = F.concat(F.translate(F.col("k").cast("string"), DIGITS, NUMERALS), F.lit("、"), F.element_at(F.array(*says), (F.col("k") % 5 + 1).cast("int")))
    lines = rows.select("source_file", "year", (F.col("k") + 1).cast("int").alias("line_no"), said.alias("raw_line"))
    titles = rows.select("source_file", "year").distinct().select("source_file", "year", F.lit(1).alias("line_no"), F.concat(F.col("year").cast("string"), F.lit("年县级以上行政区划变更情况")).alias("raw_line"))
    return titles.unionByName(lines)


def code_tables(spark: SparkSession, sf_dir: str = "") -> tuple[DataFrame, DataFrame | None]:
    """Codes of provinces to counties, and of townships."""
    if not sf_dir:
        return spark.createDataFrame(CODES, ADMIN_CODES), None
    rows = told(spark, sf_dir)
    prefix = F.concat((F.col("n_regionkey") + 11).cast("string"), (F.col("n_nationkey") + 10).cast("string"))
    path = lambda *names: F.concat_ws(",", F.lit("中国"), *names).alias("name")
    areas = rows.select(F.concat(F.substring(prefix, 1, 2), F.lit("0000")).alias("code"), path("r")).unionByName(rows.select(F.concat(prefix, F.lit("00")).alias("code"), path("r", "n")))
    return areas.distinct(), rows.select(F.concat(prefix, F.lpad(F.col("k").cast("string"), 10, "0")).alias("code"), path("r", "n", "c"))


def codes(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    areas, towns = code_tables(spark, sf_dir)
    return areas if towns is None else areas.unionByName(towns)


def sentences(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    rows = notices.sentences(notices.parse_lines(source_lines(spark, sf_dir)))
    return settle(notices.dense_ids(rows, ["source_file", "line_no", "sentence_no"], "sentence_id", "S%06d"))


def found(spark: SparkSession, sf_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """Sentences and their entities."""
    sents = sentences(spark, sf_dir)
    return sents, settle(entities.numbered(entities.extract(sents, codes(spark, sf_dir))))


def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)[1]


def q_sentence_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.sentence_entities(*found(spark, sf_dir))


def q_entity_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents, rows = found(spark, sf_dir)
    rows = rows.join(sents, "sentence_id")
    return entities.entity_frequency(rows, ["sentence_id", "start_pos"])


def q_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.method_summary(q_entities(spark, sf_dir))


def q_entity_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entity_overview(*found(spark, sf_dir))


def related(spark: SparkSession, sf_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """Sentences and the triples of their entities."""
    sents, ents = found(spark, sf_dir)
    return sents, settle(relations.relate(sents, ents))


TRIPLE = [
    "sentence_id", "emit_no", "relation_type_id", "relation_type_name", "relation_group", "predicate", "subject_text", "subject_type", "subject_admin_code", "subject_start_pos",
    "object_text", "object_type", "object_admin_code", "object_start_pos", "trigger_text", "trigger_start_pos", "trigger_end_pos", "extraction_rule", "confidence", "qualifier", "evidence_text",
]


def q_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples; an end that stands nowhere in the sentence has place -1."""
    got = related(spark, sf_dir)[1].select(*TRIPLE)
    return got.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("subject_start_pos", "object_start_pos")})


def q_relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relation_summary(related(spark, sf_dir)[1])


def q_sentence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.sentence_relations(*related(spark, sf_dir)).select("sentence_id", "sentence", "relation_count", "relation_type_ids")


def q_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.change_events(related(spark, sf_dir)[1])


def folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sents, triples = related(spark, sf_dir)
    return settle(records.numbered_records(records.build_records(sents, triples))), triples


def q_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir)[0].drop("more")


DYNAMIC = ["record_id", "year", "subject", "predicate", "object", "source_relation_type", "evidence_text", "effective_time", "type_label", "relation_type_ids", "first_type_label"]


def q_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dynamic_triples(*folded(spark, sf_dir)).select(*DYNAMIC)


def q_record_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_entities(folded(spark, sf_dir)[0])


def graph_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    rec, triples = folded(spark, sf_dir)
    units = settle(records.static_nodes(*code_tables(spark, sf_dir)))
    return rec, settle(records.dynamic_triples(rec, triples)), units, settle(records.static_affiliations(units, "2026-04-27"))


def _dated(df: DataFrame) -> DataFrame:
    """With year 0 for what has none."""
    return df.withColumn("year", F.coalesce("year", F.lit(0)))


def q_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, dynamic, units, _ = graph_parts(spark, sf_dir)
    return _dated(graph.build_nodes(rec, dynamic, units))


def q_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, dynamic, units, up = graph_parts(spark, sf_dir)
    return _dated(graph.numbered_edges(graph.build_edges(rec, dynamic, up, units)))


def q_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.timeline(folded(spark, sf_dir)[0])
    return got.withColumns({c: F.array_join(c, "|") for c in ("before_entities", "after_entities")})


def _sql_name(first: str, key: str, last: str) -> str:
    return f"'{first}' || translate(CAST({key} AS VARCHAR), '{DIGITS}', '{STEMS}') || '{last}'"


_SENT = f"""
told AS (SELECT s_suppkey AS k, s_suppkey % 5 AS t, n_regionkey, n_nationkey, {_sql_name('安', 's_suppkey', '县')} AS c, {_sql_name('安', 's_suppkey', '区')} AS d, {_sql_name('庆', 'n_nationkey', '市')} AS n, {_sql_name('盛', 'n_regionkey', '省')} AS r,
  CAST(2000 + n_nationkey % 20 AS INTEGER) AS year, CAST(n_regionkey + 11 AS VARCHAR) || CAST(n_nationkey + 10 AS VARCHAR) AS prefix, translate(CAST(s_suppkey AS VARCHAR), '{DIGITS}', '{NUMERALS}') AS item_no FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s0 AS (SELECT *, year || '_' || n_nationkey || '.txt' AS source_file, CAST(k + 1 AS INTEGER) AS line_no, prefix || lpad(CAST(k AS VARCHAR), 10, '0') AS c_code, prefix || '00' AS n_code, substr(prefix, 1, 2) || '0000' AS r_code,
  CASE t WHEN 0 THEN '撤销' || c WHEN 1 THEN '设立' || c WHEN 2 THEN c || '由' || n || '管辖' WHEN 3 THEN '将' || c || '划归' || n || '管辖' ELSE c || '更名为' || d END AS clause FROM told),
sent AS (SELECT *, clause || '。' AS sentence, printf('S%06d', row_number() OVER (ORDER BY source_file, line_no)) AS sentence_id,
  printf('CR%06d', row_number() OVER (ORDER BY source_file, line_no)) AS record_id FROM s0)
"""
_ENT = f"""{_SENT},
e0 AS (SELECT sent.*, c AS entity_text, CASE t WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS a, 'c' AS kind FROM sent
  UNION ALL SELECT sent.*, n, CASE t WHEN 2 THEN length(c) + 1 ELSE length(c) + 3 END, 'n' FROM sent WHERE t IN (2, 3) UNION ALL SELECT sent.*, d, length(c) + 3, 'd' FROM sent WHERE t = 4),
ent AS (SELECT printf('E%06d', row_number() OVER (ORDER BY sentence_id, a)) AS entity_id, sentence_id, sentence, year, CAST(a AS INTEGER) AS start_pos, CAST(a + length(entity_text) AS INTEGER) AS end_pos, entity_text, 'ADMIN_AREA' AS entity_type,
  CASE kind WHEN 'd' THEN 'regex_admin_area' ELSE 'lexicon_exact|regex_admin_area' END AS method, CASE kind WHEN 'd' THEN 0.72::DOUBLE ELSE 0.99::DOUBLE END AS confidence,
  CASE kind WHEN 'c' THEN c_code WHEN 'n' THEN n_code ELSE '' END AS admin_code, CASE kind WHEN 'c' THEN 'township' WHEN 'n' THEN 'prefecture' ELSE '' END AS admin_level, CASE kind WHEN 'd' THEN '' ELSE r END AS province,
  CASE kind WHEN 'c' THEN r WHEN 'n' THEN n ELSE '' END AS prefecture, CASE kind WHEN 'c' THEN n ELSE '' END AS county, CASE kind WHEN 'c' THEN r || '/' || n || '/' || c WHEN 'n' THEN r || '/' || n ELSE '' END AS full_path,
  entity_text AS normalized_name, CAST(kind <> 'd' AS INTEGER) AS is_from_code_table, 0 AS is_ambiguous, 0 AS is_uie_enhanced FROM e0)
"""
_TYPE = "CASE t WHEN 0 THEN 'REVOKE_ADMIN' WHEN 1 THEN 'ESTABLISH_ADMIN' WHEN 2 THEN 'JURISDICTION_ADMIN' WHEN 3 THEN 'TRANSFER_ADMIN' ELSE 'RENAME_ADMIN' END"
_TYPE_NAME = "CASE t WHEN 0 THEN '撤销建制' WHEN 1 THEN '设立建制' WHEN 2 THEN '管辖隶属' WHEN 3 THEN '区域划转' ELSE '名称变更' END"
_GROUP = "CASE WHEN t < 2 THEN '建置变化' WHEN t < 4 THEN '隶属调整' ELSE '名称变化' END"
_TRI = f"""{_SENT},
tri AS (SELECT *, 0 AS emit_no, {_TYPE} AS relation_type_id, {_TYPE_NAME} AS relation_type_name, {_GROUP} AS relation_group, 'core' AS re_status, {_TYPE_NAME} AS predicate,
  CASE t WHEN 2 THEN n ELSE c END AS subject_text, 'ADMIN_AREA' AS subject_type, CASE t WHEN 2 THEN n_code ELSE c_code END AS subject_admin_code, CAST(CASE t WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN length(c) + 1 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS subject_start_pos,
  CASE WHEN t < 2 THEN year || '年' || {_TYPE_NAME} || '事件' WHEN t = 2 THEN c WHEN t = 3 THEN n ELSE d END AS object_text, CASE WHEN t < 2 THEN 'CHANGE_EVENT' ELSE 'ADMIN_AREA' END AS object_type,
  CASE t WHEN 2 THEN c_code WHEN 3 THEN n_code ELSE '' END AS object_admin_code, CAST(CASE t WHEN 2 THEN 0 WHEN 3 THEN length(c) + 3 WHEN 4 THEN length(c) + 3 ELSE -1 END AS INTEGER) AS object_start_pos,
  CASE t WHEN 0 THEN '撤销' WHEN 1 THEN '设立' WHEN 2 THEN '管辖' WHEN 3 THEN '划归' ELSE '更名为' END AS trigger_text, CAST(CASE t WHEN 2 THEN length(c) + 1 + length(n) WHEN 3 THEN length(c) + 1 WHEN 4 THEN length(c) ELSE 0 END AS INTEGER) AS trigger_start_pos,
  CASE t WHEN 0 THEN 'revoke_clause_admins_after_trigger' WHEN 1 THEN 'establish_first_admin_after_trigger' WHEN 2 THEN 'jurisdiction_you_controller_trigger' WHEN 3 THEN 'transfer_subjects_before_trigger_to_target_after' ELSE 'rename_closest_admin_before_after' END AS extraction_rule,
  CAST(CASE t WHEN 0 THEN 0.91 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN 0.88 ELSE 0.94 END AS DOUBLE) AS confidence, '' AS qualifier, clause AS evidence_text FROM sent)
"""
_REC = f"""{_TRI},
rec AS (SELECT *, source_file || '::' || item_no AS record_key, year || '年' AS effective_time, line_no AS first_line, sentence_id AS sentence_ids, sentence AS record_text, CASE WHEN t = 1 THEN '' ELSE c END AS before_entities,
  CASE t WHEN 0 THEN '' WHEN 1 THEN c WHEN 4 THEN d ELSE n END AS after_entities, CASE t WHEN 0 THEN '撤销' WHEN 1 THEN '设立' WHEN 2 THEN '隶属' WHEN 3 THEN '划归' ELSE '更名' END AS action_keywords, relation_type_name AS type_label,
  confidence AS classification_confidence, 'RE 关系类型集合' AS classification_rule, relation_type_id AS relation_type_ids FROM tri),
dyn AS (SELECT record_id, year, CASE t WHEN 1 THEN '无旧区划（新设）' ELSE c END AS subject, CASE t WHEN 0 THEN '撤销' WHEN 1 THEN '设立' WHEN 2 THEN '隶属于' WHEN 3 THEN '划归' ELSE '变更为' END AS predicate,
  CASE t WHEN 0 THEN '无新区划（撤销）' WHEN 1 THEN c WHEN 4 THEN d ELSE n END AS object, relation_type_id AS source_relation_type, CASE WHEN t < 2 THEN sentence ELSE clause END AS evidence_text, effective_time, type_label, relation_type_ids, type_label AS first_type_label FROM rec)
"""
_GRAPH = f"""{_REC},
units AS (SELECT DISTINCT 'ADM_' || r_code AS node_id, r_code AS admin_code, r AS admin_name, 'province' AS admin_level, '中国/' || r AS full_path, '省市区' AS source_table, 'CN' AS up FROM sent
  UNION SELECT 'ADM_' || n_code, n_code, n, 'prefecture', '中国/' || r || '/' || n, '省市区', 'ADM_' || r_code FROM sent UNION SELECT 'ADM_' || c_code, c_code, c, 'township', '中国/' || r || '/' || n || '/' || c, '乡镇街道', 'ADM_' || n_code FROM sent
  UNION SELECT 'CN', 'CN', '中国', 'country', '中国', 'system', NULL),
txt AS (SELECT DISTINCT x AS t FROM (SELECT subject AS x FROM dyn UNION ALL SELECT object FROM dyn) WHERE x NOT IN (SELECT admin_name FROM units)),
ids AS (SELECT admin_name AS name, node_id FROM units UNION ALL SELECT t, 'ENT_' || substr(md5(t), 1, 16) FROM txt),
ed AS (SELECT 0 AS f, node_id AS start_id, up AS end_id, '隶属于' AS relation, 'STATIC_AFFILIATION' AS edge_type, 0 AS year, '' AS type_label, '' AS relation_type_ids, '' AS record_id, '' AS evidence_text, source_table AS source FROM units WHERE up IS NOT NULL
  UNION ALL SELECT 1, a.node_id, b.node_id, predicate, 'DYNAMIC_RELATION', year, type_label, relation_type_ids, record_id, evidence_text, source_relation_type FROM dyn JOIN ids a ON a.name = subject JOIN ids b ON b.name = object
  UNION ALL SELECT 2, 'REC_' || record_id, node_id, '涉及', 'RECORD_ENTITY', year, type_label, relation_type_ids, record_id, record_text, 'records' FROM (SELECT *, unnest([before_entities, after_entities]) AS x FROM rec) JOIN ids ON name = x WHERE x <> '')
"""
_EVENT_ID = "'EV_' || sentence_id || '_' || relation_type_id"

QUERIES = {
    "notice_entities": q_entities,
    "notice_sentence_entities": q_sentence_entities,
    "notice_entity_frequency": q_entity_frequency,
    "notice_entity_methods": q_methods,
    "notice_entity_overview": q_entity_overview,
    "notice_triples": q_triples,
    "notice_relation_summary": q_relation_summary,
    "notice_sentence_relations": q_sentence_relations,
    "notice_change_events": q_events,
    "notice_records": q_records,
    "notice_record_entities": q_record_entities,
    "notice_dynamic_triples": q_dynamic,
    "notice_graph_nodes": q_nodes,
    "notice_graph_edges": q_edges,
    "notice_timeline": q_timeline,
}
ORACLES: dict = {
    "notice_entities": f"WITH {_ENT} SELECT * EXCLUDE (sentence, year) FROM ent",
    "notice_sentence_entities": f"""WITH {_ENT}, g AS (SELECT sentence_id, count(*) AS en, count(*) FILTER (admin_code <> '') AS em, string_agg(entity_text, ' / ' ORDER BY start_pos) AS ex FROM ent GROUP BY 1)
SELECT sentence_id, source_file, sent.year, line_no, item_no, 0 AS sentence_no, sentence, en AS entity_count, en AS admin_area_count, CAST(0 AS BIGINT) AS gov_org_count, CAST(0 AS BIGINT) AS address_count, em AS coded_admin_count, ex AS entities FROM sent JOIN g USING (sentence_id)""",
    "notice_entity_frequency": f"WITH {_ENT} SELECT entity_type, normalized_name, count(*) AS count, count(DISTINCT sentence_id) AS sentence_count, min(year) AS first_year, max(year) AS last_year, max(method) AS methods, max(admin_code) AS admin_codes, max(admin_level) AS admin_levels, arg_min(sentence, sentence_id) AS example_sentence FROM ent GROUP BY 1, 2",
    "notice_entity_methods": f"WITH {_ENT}, m AS (SELECT *, unnest(string_split(method, '|')) AS one FROM ent) SELECT entity_type, one AS method, count(*) AS entity_count, count(DISTINCT normalized_name) AS unique_entity_count, {half_even('avg(confidence)', 4)} AS avg_confidence FROM m GROUP BY 1, 2",
    "notice_entity_overview": f"""WITH {_ENT} SELECT (SELECT count(*) FROM sent) AS sentence_count, count(*) AS entity_count, count(DISTINCT normalized_name) AS unique_entity_count, count(DISTINCT sentence_id) AS sentence_with_entity_count, count(*) AS admin_area_count,
  CAST(0 AS BIGINT) AS gov_org_count, CAST(0 AS BIGINT) AS address_count, count(*) FILTER (admin_code <> '') AS coded_entity_count, CAST(0 AS BIGINT) AS ambiguous_entity_count FROM ent""",
    "notice_triples": f"WITH {_TRI} SELECT {', '.join(c if c != 'trigger_end_pos' else 'CAST(trigger_start_pos + length(trigger_text) AS INTEGER) AS trigger_end_pos' for c in TRIPLE)} FROM tri",
    "notice_relation_summary": f"WITH {_TRI} SELECT relation_type_id, relation_type_name, relation_group, re_status, count(*) AS triple_count, count(DISTINCT sentence_id) AS sentence_count, count(DISTINCT subject_text) AS subject_count, count(DISTINCT object_text) AS object_count, max(confidence) AS avg_confidence FROM tri GROUP BY 1, 2, 3, 4",
    "notice_sentence_relations": f"WITH {_TRI} SELECT sentence_id, sentence, CAST(1 AS BIGINT) AS relation_count, relation_type_id AS relation_type_ids FROM tri",
    "notice_change_events": f"WITH {_TRI} SELECT {_EVENT_ID} AS event_id, object_text AS event_text, relation_type_id, sentence_id, CAST(1 AS BIGINT) AS subject_count, subject_text AS subjects, evidence_text FROM tri WHERE t < 2",
    "notice_records": f"WITH {_REC} SELECT record_id, record_key, source_file, year, effective_time, item_no, first_line, sentence_ids, record_text, before_entities, after_entities, action_keywords, type_label, classification_confidence, classification_rule, relation_type_ids FROM rec",
    "notice_record_entities": f"WITH {_REC} SELECT record_id, year, record_text, before_entities AS 变更前实体, after_entities AS 变更后实体, type_label AS 变更类型, action_keywords AS 变更动作关键词, classification_confidence AS 置信度 FROM rec",
    "notice_dynamic_triples": f"WITH {_REC} SELECT {', '.join(DYNAMIC)} FROM dyn",
    "notice_graph_nodes": f"""WITH {_GRAPH} SELECT node_id, 'AdminArea' AS node_type, admin_name AS name, admin_code, admin_level, 0 AS year, '' AS type_label, full_path AS text, source_table AS source FROM units
  UNION ALL SELECT 'REC_' || record_id, 'Record', record_id, '', '', year, type_label, record_text, source_file FROM rec UNION ALL SELECT 'ENT_' || substr(md5(t), 1, 16), 'TextEntity', t, '', '', 0, '', t, 'records' FROM txt""",
    "notice_graph_edges": f"WITH {_GRAPH} SELECT printf('KG_E%08d', row_number() OVER (ORDER BY f, start_id, end_id, relation, record_id, evidence_text)) AS edge_id, * EXCLUDE (f) FROM ed",
    "notice_timeline": f"WITH {_REC} SELECT record_id, year, type_label, before_entities, after_entities, record_text AS text FROM rec",
}
