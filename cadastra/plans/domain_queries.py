"""Label, graph, serving, span, spatial and window operators on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import entities, graph, labels, records, serving, spatial
from cadastra.plans.sql import half_even
from cadastra.sources.tables import load
from cadastra.streaming import events as stream

ORDER = ["AF", "NF", "NO", "RF", "XX"]
CLASSES = {"AF": "closed", "RF": "closed", "NF": "mixed", "NO": "open"}
NAMES = ["example", "example.com", "com", "net", "en/", "http", "https", "org"]
#: The 25 labels of the classifier.
BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the set of their lines' states, and a guess of it from the larger lines."""
    li = load(spark, sf_dir, "lineitem").withColumn("state", F.concat("l_returnflag", "l_linestatus"))
    per = li.groupBy(F.col("l_orderkey").alias("record_id")).agg(
        F.array_sort(F.collect_set("state")).alias("actual"),
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 20, F.col("state")))).alias("guess"),
        (F.sum((F.col("l_discount") * 100).cast("long")) / F.count("*")).alias("confidence"),
    )
    return per.withColumn("predicted", F.when(F.size("guess") > 0, F.col("guess")).otherwise(F.array(F.lit("NO")))).drop("guess")


def q_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.assignments(label_records(spark, sf_dir), "actual")
    return labels.class_frequency(rows, "confidence")


def q_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.combination_counts(label_records(spark, sf_dir), "actual")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.assignments(label_records(spark, sf_dir), "actual").groupBy("type_id").count()


def q_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.zero_filled(counts(spark, sf_dir), "type_id", ORDER)


def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.rollup(counts(spark, sf_dir), "type_id", CLASSES)


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.confusion(label_records(spark, sf_dir), "actual", "predicted", ORDER)


def q_confusion_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.confusion_rollup(q_confusion(spark, sf_dir), CLASSES)


def q_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.evaluation(label_records(spark, sf_dir), "actual", "predicted", ORDER)


def q_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.capped(label_records(spark, sf_dir), "actual", 20, ["record_id"]).select("record_id", F.array_join("actual", "|").alias("labels"))


def q_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = labels.tf_idf(load(spark, sf_dir, "part"), "p_partkey", labels.char_ngrams(F.col("p_name")))
    return got.withColumn("weight", F.bround("weight", 6))


def q_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.array("p_brand").alias("brand"))
    got = labels.train_and_predict(parts, "p_partkey", "text", "brand", BRANDS)
    return got.select("p_partkey", "is_test", F.array_join("brand", "|").alias("actual"), F.array_join("predicted", "|").alias("predicted"))


def areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions and nations as a code table of provinces and prefectures, suppliers as one of townships."""
    r, n, s = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    region = r.select(F.concat((F.col("r_regionkey") + 11).cast("string"), F.lit("0000")).alias("code"), F.concat_ws(",", F.lit("中国"), "r_name").alias("name"))
    nation = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    prefix = F.concat((F.col("n_regionkey") + 11).cast("string"), (F.col("n_nationkey") + 10).cast("string"))
    own = s.join(nation, s["s_nationkey"] == n["n_nationkey"])
    own = own.select(F.concat(prefix, F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("code"), F.concat_ws(",", F.lit("中国"), "r_name", "n_name", "s_name").alias("name"))
    nation = nation.select(F.concat(prefix, F.lit("00")).alias("code"), F.concat_ws(",", F.lit("中国"), "r_name", "n_name").alias("name"))
    return region.unionByName(nation), own


def q_static_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.static_nodes(*areas(spark, sf_dir))


def q_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.static_affiliations(q_static_nodes(spark, sf_dir), "1")


def q_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(q_affiliations(spark, sf_dir), "subject_node_id", "object_node_id")


def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = q_static_nodes(spark, sf_dir)
    return graph.paths(records.static_affiliations(nodes), nodes, "subject_node_id", "object_node_id", "node_id", "admin_name")


def q_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = q_static_nodes(spark, sf_dir)
    return graph.children_of(records.static_affiliations(nodes), nodes, "110000").select("node_id", "admin_name", "admin_level")


def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations, ends of suppliers' paths, and middles of nations' paths."""
    r, n, s = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    own = n.join(s, n["n_nationkey"] == s["s_nationkey"]).select(F.concat("n_name", F.lit("/"), "s_name").alias("name"))
    inside = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/")).alias("name"))
    wanted = n.select(F.col("n_name").alias("name")).unionByName(own).unionByName(inside)
    return graph.resolve(q_static_nodes(spark, sf_dir), "admin_name", "full_path", "admin_code", wanted)


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same text, each linked to its smallest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = docs.join(least, "h").where("doc_id != b").select(F.col("doc_id").alias("a"), "b")
    return graph.connected_components(stars, "a", "b")


def q_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.overview({t: load(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")})


def q_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = serving.holds("1%", ["p_name", "p_type"]) | serving.holds("ST", ["p_name", "p_type"])
    return serving.limited(load(spark, sf_dir, "part").where(hit), ["p_partkey"], 50).select("p_partkey", "p_name", "p_type")


def q_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("count"))
    return serving.limited(rows, [F.desc("count"), "l_partkey"], 20)


def q_graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = q_static_nodes(spark, sf_dir)
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = c.select(F.col("c_name").alias("subject"), F.col("n_name").alias("object"))
    return serving.overview_graph(nodes, records.static_affiliations(nodes), edges, ["province", "prefecture"])


def q_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return entities.dictionary_matches(load(spark, sf_dir, "pages").select("page_id", "url"), names, "url", ["page_id"])


def q_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = q_matches(spark, sf_dir).withColumn("length", F.char_length("name"))
    return entities.greedy(got, ["page_id"], ["length"], ["start_pos", "end_pos", "name"])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", (F.col("c_custkey") * 37 % 3600 / 10 - 180).alias("lon"), (F.col("c_custkey") * 53 % 1800 / 10 - 90).alias("lat"), F.rint("c_acctbal").alias("value"))


def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.grid_sum(points(spark, sf_dir), "lon", "lat", "value", 30.0)


def q_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes, one with a hole, as polygons around made-up points."""
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    polygons = [("west", 1, [box(-150.05, -60.05, -20.05, 60.05), box(-100.05, -30.05, -60.05, 30.05)]), ("east", 2, [box(-40.05, -40.05, 120.05, 40.05)])]
    shapes = spark.createDataFrame(polygons, "polygon_id string, ordinal int, polygon array<array<array<double>>>")
    return spatial.locate(points(spark, sf_dir), shapes, ["c_custkey"], size=20.0).select("c_custkey", "polygon_id")


def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stream.tumbling(load(spark, sf_dir, "events"), "1 hour")
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stream.sessions(load(spark, sf_dir, "events"), "30 minutes")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


_LABELS = """
li AS (SELECT l_orderkey AS record_id, l_returnflag || l_linestatus AS s, l_quantity AS q, CAST(l_discount * 100 AS DOUBLE) AS d FROM lineitem),
rec AS (SELECT record_id, list_sort(list_distinct(list(s))) AS actual, list_sort(list_distinct(list(s) FILTER (q > 20))) AS guess, CAST(sum(CAST(trunc(d) AS BIGINT)) AS DOUBLE) / count(*) AS confidence FROM li GROUP BY 1),
lab AS (SELECT record_id, actual, CASE WHEN len(coalesce(guess, [])) > 0 THEN guess ELSE ['NO'] END AS predicted, confidence FROM rec),
asg AS (SELECT *, unnest(actual) AS type_id FROM lab)
"""
_CONF = f"""{_LABELS}, o AS (SELECT unnest({ORDER}) AS type_id),
cf AS (SELECT type_id, count(*) FILTER (list_contains(actual, type_id) AND list_contains(predicted, type_id)) AS true_positive, count(*) FILTER (NOT list_contains(actual, type_id) AND list_contains(predicted, type_id)) AS false_positive,
 count(*) FILTER (list_contains(actual, type_id) AND NOT list_contains(predicted, type_id)) AS false_negative, count(*) FILTER (NOT list_contains(actual, type_id) AND NOT list_contains(predicted, type_id)) AS true_negative FROM lab CROSS JOIN o GROUP BY 1)"""


def _scores() -> str:
    tp, fp, fn = "true_positive", "false_positive", "false_negative"
    share = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"
    parts = {"precision": share(tp, f"{tp} + {fp}"), "recall": share(tp, f"{tp} + {fn}"), "f1": share(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")}
    return ", ".join(f"{half_even(v, 4)} AS {k}" for k, v in parts.items())


_AREAS = """
nr AS (SELECT *, CAST(n_regionkey + 11 AS VARCHAR) || CAST(n_nationkey + 10 AS VARCHAR) AS prefix FROM nation JOIN region ON n_regionkey = r_regionkey),
ar AS (SELECT CAST(r_regionkey + 11 AS VARCHAR) || '0000' AS code, [r_name] AS p FROM region UNION ALL SELECT prefix || '00', [r_name, n_name] FROM nr UNION ALL
 SELECT prefix || lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), [r_name, n_name, s_name] FROM supplier JOIN nr ON s_nationkey = n_nationkey),
nodes AS (SELECT 'ADM_' || code AS node_id, code AS admin_code, p[-1] AS admin_name, CASE WHEN length(code) > 6 THEN 'township' WHEN code LIKE '%0000' THEN 'province' ELSE 'prefecture' END AS admin_level,
 coalesce(p[1], '') AS province, coalesce(p[2], '') AS prefecture, coalesce(p[3], '') AS county, '中国/' || array_to_string(p, '/') AS full_path, CASE WHEN length(code) > 6 THEN '乡镇街道' ELSE '省市区' END AS source_table FROM ar
 UNION ALL SELECT 'CN', 'CN', '中国', 'country', '', '', '', '中国', 'system'),
aff AS (SELECT a.node_id AS subject_node_id, a.admin_code AS subject_code, a.admin_name AS subject_name, '隶属于' AS predicate, coalesce(w.node_id, x.node_id, y.node_id, 'CN') AS object_node_id,
 coalesce(w.admin_name, x.admin_name, y.admin_name, '中国') AS object_name, a.source_table, '1' AS version_date
 FROM nodes a LEFT JOIN nodes w ON a.admin_level = 'township' AND w.admin_code = substr(a.admin_code, 1, 6) LEFT JOIN nodes x ON a.admin_level = 'township' AND x.admin_code = substr(a.admin_code, 1, 4) || '00'
 LEFT JOIN nodes y ON a.admin_level <> 'province' AND y.admin_code = substr(a.admin_code, 1, 2) || '0000' WHERE a.node_id <> 'CN')
"""
_UP = f"""WITH RECURSIVE {_AREAS}, up AS (SELECT subject_node_id AS node, object_node_id AS ancestor, 1 AS distance FROM aff UNION ALL SELECT node, object_node_id, distance + 1 FROM up JOIN aff ON ancestor = subject_node_id)"""
_MATCHES = f"""WITH n AS (SELECT unnest({NAMES}) AS name), m AS (SELECT page_id, url, name, unnest(range(1, length(url) - length(name) + 2)) AS i FROM pages CROSS JOIN n)
SELECT page_id, CAST(i - 1 AS INTEGER) AS start_pos, CAST(i - 1 + length(name) AS INTEGER) AS end_pos, name FROM m WHERE substr(url, i, length(name)) = name"""
_POINTS = "p AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 1800) / 10.0::DOUBLE - 90 AS lat, round_even(c_acctbal, 0) AS value FROM customer)"

QUERIES = {
    "label_frequency": q_frequency,
    "label_combinations": q_combinations,
    "label_distribution": q_zero_filled,
    "label_rollup": q_rollup,
    "label_confusion": q_confusion,
    "label_confusion_rollup": q_confusion_rollup,
    "label_evaluation": q_evaluation,
    "label_capped": q_capped,
    "char_tf_idf": q_tf_idf,
    "text_classifier": q_classifier,
    "static_nodes": q_static_nodes,
    "static_affiliations": q_affiliations,
    "ancestors": q_ancestors,
    "hierarchy_paths": q_paths,
    "children": q_children,
    "name_resolution": q_resolve,
    "connected_components": q_components,
    "table_overview": q_overview,
    "keyword_filter": q_keyword,
    "top_k": q_top,
    "graph_overview": q_graph_overview,
    "dictionary_matches": q_matches,
    "greedy_spans": q_greedy,
    "grid_sum": q_grid,
    "points_in_polygons": q_polygons,
    "event_windows": q_windows,
    "event_sessions": q_sessions,
}
ORACLES = {
    "label_frequency": f"WITH {_LABELS} SELECT type_id, count(DISTINCT record_id) AS record_count, count(*) AS label_assignment_count, {half_even('avg(confidence)', 4)} AS avg_confidence FROM asg GROUP BY 1",
    "label_combinations": f"WITH {_LABELS} SELECT array_to_string(actual, ' / ') AS labels, count(*) AS count FROM lab GROUP BY 1",
    "label_distribution": f"WITH {_LABELS}, o AS (SELECT unnest({ORDER}) AS type_id, CAST(unnest(range({len(ORDER)})) AS INTEGER) AS position), c AS (SELECT type_id, count(*) AS count FROM asg GROUP BY 1) SELECT type_id, position, coalesce(count, 0) AS count FROM o LEFT JOIN c USING (type_id)",
    "label_rollup": f"WITH {_LABELS} SELECT CASE WHEN type_id IN ('AF', 'RF') THEN 'closed' WHEN type_id = 'NF' THEN 'mixed' WHEN type_id = 'NO' THEN 'open' END AS class, count(*) AS count FROM asg WHERE type_id IN ('AF', 'RF', 'NF', 'NO') GROUP BY 1",
    "label_confusion": f"WITH {_CONF} SELECT *, {_scores()} FROM cf",
    "label_confusion_rollup": f"""WITH {_CONF}, r AS (SELECT CASE WHEN type_id IN ('AF', 'RF') THEN 'closed' WHEN type_id = 'NF' THEN 'mixed' WHEN type_id = 'NO' THEN 'open' END AS class, sum(true_positive)::BIGINT AS true_positive, sum(false_positive)::BIGINT AS false_positive,
 sum(false_negative)::BIGINT AS false_negative, sum(true_negative)::BIGINT AS true_negative FROM cf GROUP BY 1) SELECT *, {_scores()} FROM r WHERE class IS NOT NULL""",
    "label_evaluation": f"""WITH {_CONF}, f AS (SELECT *, CASE WHEN 2 * true_positive + false_positive + false_negative = 0 THEN 0.0::DOUBLE ELSE (2 * true_positive)::DOUBLE / (2 * true_positive + false_positive + false_negative) END AS f1 FROM cf),
t AS (SELECT sum(true_positive) AS tp, sum(false_positive) AS fp, sum(false_negative) AS fn, sum(true_negative) AS tn, avg(f1) AS m FROM f), e AS (SELECT count(*) AS n, avg(CASE WHEN list_sort(actual) = list_sort(predicted) THEN 1.0::DOUBLE ELSE 0.0 END) AS x FROM lab)
SELECT n AS sample_count, {half_even('x', 4)} AS exact_match_accuracy, {half_even('(2 * tp)::DOUBLE / (2 * tp + fp + fn)', 4)} AS micro_f1, {half_even('m', 4)} AS macro_f1, {half_even('(fp + fn)::DOUBLE / (fp + fn + tp + tn)', 4)} AS hamming_loss, {half_even('1 - (fp + fn)::DOUBLE / (fp + fn + tp + tn)', 4)} AS label_accuracy FROM t, e""",
    "label_capped": f"WITH {_LABELS}, k AS (SELECT record_id, row_number() OVER (PARTITION BY type_id ORDER BY len(actual), record_id) AS k FROM asg) SELECT record_id, array_to_string(actual, '|') AS labels FROM lab WHERE record_id IN (SELECT record_id FROM k WHERE k <= 20)",
    "char_tf_idf": f"""WITH t AS (SELECT p_partkey, regexp_replace(lower(p_name), '\\s+', ' ', 'g') AS x FROM part), g AS (SELECT p_partkey, x, n, unnest(range(1, length(x) - n + 2)) AS i FROM t, (SELECT unnest([2, 3, 4]) AS n)),
c AS (SELECT p_partkey, substr(x, i, n) AS term, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT p_partkey, term, tf, tf * (ln((1 + (SELECT count(*) FROM part))::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN d USING (term)), n AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS weight FROM w)
SELECT p_partkey, term, tf, {half_even('weight', 6)} AS weight FROM n""",
    "static_nodes": f"WITH {_AREAS} SELECT * FROM nodes",
    "static_affiliations": f"WITH {_AREAS} SELECT * FROM aff",
    "ancestors": f"{_UP} SELECT * FROM up",
    "hierarchy_paths": f"""{_UP}, q AS (SELECT node, max(distance) AS depth, string_agg(admin_name, '/' ORDER BY distance DESC) AS p FROM up JOIN nodes ON ancestor = node_id GROUP BY 1)
SELECT node_id AS node, CAST(coalesce(depth, 0) AS INTEGER) AS depth, coalesce(p || '/', '') || admin_name AS path FROM nodes LEFT JOIN q ON node = node_id""",
    "children": f"WITH {_AREAS} SELECT node_id, admin_name, admin_level FROM nodes JOIN aff ON subject_node_id = node_id WHERE object_node_id = 'ADM_110000'",
    "name_resolution": f"""WITH {_AREAS}, w AS (SELECT n_name AS name FROM nation UNION ALL SELECT n_name || '/' || s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey UNION ALL SELECT r_name || '/' || n_name || '/' FROM nr), e AS (SELECT name, arg_min(admin_code, (length(admin_code), admin_code)) AS code FROM w JOIN nodes ON admin_name = name GROUP BY 1),
r AS (SELECT name, arg_max(admin_code, (CASE WHEN ends_with(full_path, name) THEN 400 ELSE 300 END + length(full_path), admin_code)) AS code FROM w JOIN nodes ON contains(full_path, name) WHERE name NOT IN (SELECT name FROM e) GROUP BY 1) SELECT * FROM e UNION ALL SELECT * FROM r""",
    "connected_components": "WITH g AS (SELECT md5(text) AS h, min(doc_id) AS component, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id AS node, component FROM documents JOIN g ON md5(text) = h WHERE n > 1",
    "table_overview": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")),
    "keyword_filter": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), '1%') OR contains(lower(p_type), '1%') OR contains(lower(p_name), 'st') OR contains(lower(p_type), 'st') ORDER BY p_partkey LIMIT 50",
    "top_k": "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "graph_overview": f"""WITH {_AREAS}, c AS (SELECT n_name AS admin_name, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT node_id, admin_code, admin_name, admin_level, object_node_id AS parent_id, coalesce(k, 0) AS relation_count FROM nodes JOIN aff ON subject_node_id = node_id LEFT JOIN c USING (admin_name) WHERE admin_level IN ('province', 'prefecture')""",
    "dictionary_matches": _MATCHES,
    "greedy_spans": f"""WITH w AS ({_MATCHES}), g AS (SELECT page_id, list([{{'s': start_pos, 'e': end_pos, 'n': name}}] ORDER BY length(name) DESC, start_pos, end_pos, name) AS l FROM w GROUP BY 1),
k AS (SELECT page_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: x[1].s < y.e AND y.s < x[1].e)) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM g)
SELECT page_id, k.s AS start_pos, k.e AS end_pos, k.n AS name FROM k""",
    "grid_sum": f"WITH {_POINTS} SELECT CAST(floor((lon + 180) / 30) AS BIGINT) AS cell_x, CAST(floor((lat + 90) / 30) AS BIGINT) AS cell_y, sum(value) AS value, count(*) AS pixel_count, -180 + (floor((lon + 180) / 30) + 0.5::DOUBLE) * 30 AS lon, -90 + (floor((lat + 90) / 30) + 0.5::DOUBLE) * 30 AS lat FROM p GROUP BY ALL",
    "points_in_polygons": f"""WITH {_POINTS}, q AS (SELECT c_custkey, (lon BETWEEN -150.05 AND -20.05 AND lat BETWEEN -60.05 AND 60.05) AND NOT (lon BETWEEN -100.05 AND -60.05 AND lat BETWEEN -30.05 AND 30.05) AS w, lon BETWEEN -40.05 AND 120.05 AND lat BETWEEN -40.05 AND 40.05 AS e FROM p)
SELECT c_custkey, CASE WHEN w THEN 'west' ELSE 'east' END AS polygon_id FROM q WHERE w OR e""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY 1""",
}
