"""A property graph of units, records and text entities: nodes, edges, hierarchy, components, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.text import split_list, stable_id
from cadastra.operators.notices import dense_ids
from cadastra.operators.stages import settle

NODE = ["node_id", "node_type", "name", "admin_code", "admin_level", "year", "type_label", "text", "source"]


def normalized(x: Column) -> Column:
    """An end of an edge as a name: edge marks off, but for the stand-ins for no unit."""
    plain = F.trim(F.coalesce(x, F.lit("")))
    return F.when(plain.startswith("无旧区划") | plain.startswith("无新区划"), plain).otherwise(F.btrim(plain, F.lit(" ，。；;、")))


def unique_names(nodes: DataFrame) -> DataFrame:
    """(name, node_id) of the names that one unit alone has."""
    return nodes.groupBy(F.col("admin_name").alias("name")).agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n = 1 and name != ''").drop("n")


def linked(df: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
    """With the node of a text: the unit of that name if there is just one, else a content-addressed one."""
    text = normalized(F.col(column))
    df = df.withColumn("_n", text).join(names.select(F.col("name").alias("_n"), F.col("node_id").alias("_id")), "_n", "left")
    return df.withColumn(out, F.coalesce("_id", stable_id(F.col("_n")))).drop("_n", "_id")


def ends(records: DataFrame) -> Column:
    return F.concat(split_list(F.col("before_entities")), split_list(F.col("after_entities")))


def build_nodes(records: DataFrame, dynamic: DataFrame, units: DataFrame) -> DataFrame:
    """Units, records, and the texts at edges that are no unit's own name."""
    none = F.lit("")
    year = F.lit(None).cast("int")
    a = units.select("node_id", F.lit("AdminArea").alias("node_type"), F.col("admin_name").alias("name"), "admin_code", "admin_level", year.alias("year"), none.alias("type_label"), F.col("full_path").alias("text"), F.col("source_table").alias("source"))
    b = records.select(F.concat(F.lit("REC_"), "record_id").alias("node_id"), F.lit("Record").alias("node_type"), F.col("record_id").alias("name"), none.alias("admin_code"), none.alias("admin_level"), F.col("year").cast("int").alias("year"), "type_label", F.col("record_text").alias("text"), F.col("source_file").alias("source"))
    texts = dynamic.select(F.explode(F.array("subject", "object")).alias("t")).unionByName(records.select(F.explode(ends(records)).alias("t")))
    texts = texts.select(normalized(F.col("t")).alias("t")).where("t != ''").distinct()
    texts = linked(texts, "t", unique_names(units), "node_id").join(units.select("node_id"), "node_id", "left_anti")
    c = texts.select("node_id", F.lit("TextEntity").alias("node_type"), F.col("t").alias("name"), none.alias("admin_code"), none.alias("admin_level"), year.alias("year"), none.alias("type_label"), F.col("t").alias("text"), F.lit("records").alias("source"))
    return reduce(DataFrame.unionByName, (a, b, c)).select(*NODE)


def build_edges(records: DataFrame, dynamic: DataFrame, affiliations: DataFrame, units: DataFrame) -> DataFrame:
    """Static affiliations, dynamic relations and records' entities, in three families."""
    names, none = unique_names(units), F.lit("")
    a = affiliations.select(
        F.col("subject_node_id").alias("start_id"), F.col("object_node_id").alias("end_id"), F.col("predicate").alias("relation"), F.lit("STATIC_AFFILIATION").alias("edge_type"),
        F.lit(None).cast("int").alias("year"), none.alias("type_label"), none.alias("relation_type_ids"), none.alias("record_id"), none.alias("evidence_text"), F.col("source_table").alias("source"),
    )
    d = dynamic.where((normalized(F.col("subject")) != "") & (normalized(F.col("object")) != ""))
    d = linked(linked(d, "subject", names, "start_id"), "object", names, "end_id").select(
        "start_id", "end_id", F.col("predicate").alias("relation"), F.lit("DYNAMIC_RELATION").alias("edge_type"), F.col("year").cast("int").alias("year"), "type_label", "relation_type_ids",
        "record_id", "evidence_text", F.col("source_relation_type").alias("source"),
    )
    r = records.select("*", F.explode(ends(records)).alias("t"))
    r = linked(r, "t", names, "end_id").select(
        F.concat(F.lit("REC_"), "record_id").alias("start_id"), "end_id", F.lit("涉及").alias("relation"), F.lit("RECORD_ENTITY").alias("edge_type"), F.col("year").cast("int").alias("year"), "type_label",
        "relation_type_ids", "record_id", F.col("record_text").alias("evidence_text"), F.lit("records").alias("source"),
    )
    return reduce(DataFrame.unionByName, (a, d, r))


def numbered_edges(edges: DataFrame) -> DataFrame:
    family = F.when(F.col("edge_type") == "STATIC_AFFILIATION", 0).when(F.col("edge_type") == "DYNAMIC_RELATION", 1).otherwise(2)
    order = ["_f", "start_id", "end_id", "relation", "record_id", "evidence_text"]
    return dense_ids(edges.withColumn("_f", family), order, "edge_id", "KG_E%08d").drop("_f")


def ancestors(edges: DataFrame, child: str, parent: str, depth: int = 0) -> DataFrame:
    """(node, ancestor, distance) of every node by its parent edges, up to ``depth`` steps; 0 means all.

    One join per step until no node has another ancestor; a cycle ends at a node already on the path.
    The edges and each step's rows are settled, as the next step reads them."""
    step = settle(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node != ancestor"))
    level = step.select("node", "ancestor", F.array("node", "ancestor").alias("path"))
    parts = [level.select("node", "ancestor", F.lit(1).alias("distance"))]
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    while depth == 0 or len(parts) < depth:
        level = level.join(up, "ancestor").where(~F.array_contains("path", F.col("next")))
        level = settle(level.select("node", F.col("next").alias("ancestor"), F.concat("path", F.array("next")).alias("path")))
        if level.isEmpty():
            break
        parts.append(level.select("node", "ancestor", F.lit(len(parts) + 1).alias("distance")))
    return reduce(DataFrame.unionByName, parts)


def paths(edges: DataFrame, nodes: DataFrame, child: str, parent: str, node: str, name: str, depth: int = 0) -> DataFrame:
    """(node, depth, path) from the root down, names joined by /."""
    up = ancestors(edges, child, parent, depth)
    named = up.join(nodes.select(F.col(node).alias("ancestor"), F.col(name).alias("a_name")), "ancestor")
    folded = named.groupBy("node").agg(F.max("distance").alias("depth"), F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "a_name"))).alias("_p"))
    own = nodes.select(F.col(node).alias("node"), F.col(name).alias("_own")).join(folded, "node", "left")
    way = F.concat(F.coalesce(F.transform("_p", lambda x: x["a_name"]), F.array().cast("array<string>")), F.array("_own"))
    return own.select("node", F.coalesce("depth", F.lit(0)).alias("depth"), F.array_join(way, "/").alias("path"))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, by minimum labels and pointer jumping.

    Lineage is cut each round by a checkpoint in the folder that executors share. Raises RuntimeError
    where ``rounds`` are not enough: labels move at least two steps a round, so long chains may need more.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = settle(both)
    label = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
    for _ in range(rounds):
        label = settle(label)
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        nxt = label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("component", "m").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("j"))
        nxt = settle(nxt.join(jump, "component", "left").select("node", F.least("component", F.coalesce("j", "component")).alias("component")))
        if nxt.join(label.withColumnRenamed("component", "was"), "node").where("was != component").isEmpty():
            return nxt
        label = nxt
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def neighbourhood(nodes: DataFrame, edges: DataFrame, keyword: str, limit: int = 80) -> tuple[DataFrame, DataFrame]:
    """Nodes whose name holds a keyword with the nodes an edge away, and at most ``limit`` edges among them."""
    hits = nodes.where(F.col("name").contains(keyword)).select("node_id")
    near = edges.join(hits.withColumnRenamed("node_id", "start_id"), "start_id", "left_semi").unionByName(edges.join(hits.withColumnRenamed("node_id", "end_id"), "end_id", "left_semi"))
    near = near.distinct().orderBy("edge_type", "start_id", "end_id", "relation").limit(limit)
    ids = near.select(F.explode(F.array("start_id", "end_id")).alias("node_id")).unionByName(hits).distinct()
    return nodes.join(ids, "node_id", "left_semi"), near


def resolve(nodes: DataFrame, name: str, path: str, code: str, wanted: DataFrame) -> DataFrame:
    """The best node for each wanted name: its own name (shortest code first), else a path that ends
    with it, else one that holds it.

    Own names meet by an equi-join. Of names left over, those with the same text at some place of a path
    meet it by that text: a path is cut into pieces of the few lengths that these names have."""
    at = nodes.select(F.col(name).alias("_n"), F.col(path).alias("_p"), F.col(code).alias("_c"))
    wanted = settle(wanted.select("name").distinct())
    exact = at.join(wanted.select(F.col("name").alias("_n")), "_n").groupBy("_n").agg(F.min_by("_c", F.struct(F.length("_c"), "_c")).alias("code"))
    exact = settle(exact.select(F.col("_n").alias("name"), "code"))
    rest = settle(wanted.join(exact, "name", "left_anti"))
    # as many as a path is long at most: a longer name is in no path
    longest = at.agg(F.max(F.length("_p"))).first()[0] or 0
    lengths = [r[0] for r in rest.select(F.length("name").alias("n")).where((F.col("n") > 0) & (F.col("n") <= longest)).distinct().orderBy("n").collect()]
    none = F.array().cast("array<string>")

    def cut(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length("_p") - n + 1)
        return F.when(F.length("_p") >= n, F.transform(places, lambda i: F.substr("_p", i, F.lit(n)))).otherwise(none)

    pieces = F.array_distinct(F.concat(none, *map(cut, lengths)))
    inside = at.select("_p", "_c", F.explode(pieces).alias("name")).join(rest, "name")
    score = F.when(F.col("_p").endswith(F.col("name")), 400).otherwise(300) + F.length("_p")
    loose = inside.groupBy("name").agg(F.max_by("_c", F.struct(score, "_c")).alias("code"))
    return exact.unionByName(loose)


def timeline(records: DataFrame) -> DataFrame:
    return records.select("record_id", "year", "type_label", split_list(F.col("before_entities")).alias("before_entities"), split_list(F.col("after_entities")).alias("after_entities"), F.col("record_text").alias("text"))


def children_of(edges: DataFrame, nodes: DataFrame, parent_code: str, levels: list[str] | None = None) -> DataFrame:
    """The units right below one, in code order."""
    parent = nodes.where(F.col("admin_code") == parent_code).select(F.col("node_id").alias("object_node_id"))
    below = edges.join(parent, "object_node_id", "left_semi").select(F.col("subject_node_id").alias("node_id"))
    out = nodes.join(below, "node_id", "left_semi")
    return (out.where(F.col("admin_level").isin(levels)) if levels else out).orderBy("admin_code", "admin_name")


def tree(nodes: DataFrame, edges: DataFrame, root: str, depth: int) -> dict:
    """A nested document of the units down to ``depth`` below the root, for display: only they are gathered."""
    up = ancestors(edges, "subject_node_id", "object_node_id", depth).where(F.col("ancestor") == root)
    inside = up.select(F.col("node").alias("node_id")).unionByName(nodes.where(F.col("node_id") == root).select("node_id"))
    rows = nodes.join(inside, "node_id", "left_semi").join(edges.select(F.col("subject_node_id").alias("node_id"), "object_node_id"), "node_id", "left")
    items = {r["node_id"]: ({"id": r["node_id"], "name": r["admin_name"], "code": r["admin_code"], "level": r["admin_level"], "children": []}, r["object_node_id"]) for r in rows.collect()}
    for item, parent in sorted(items.values(), key=lambda x: (x[0]["code"], x[0]["name"])):
        if parent in items and item["id"] != root:
            items[parent][0]["children"].append(item)
    return items[root][0] if root in items else {"id": root, "children": []}


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
