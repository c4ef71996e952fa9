"""The graph around a keyword: a unit with what is above and below it, and the relations that name it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.operators.entities import dictionary_matches
from cadastra.operators.graph import connected_components, resolve
from cadastra.operators.stages import settle

# Categories of nodes, the relation of a unit to what is below it, and what an edge without a counterpart has.
ROOT, UNIT, TEXT, MISSING = "查询区划", "静态区划", "历史动态实体", "变更缺省端点"
BELOW = "下辖"
STAND_INS = ["无旧区划", "无新区划"]
#: Levels of units that can hold a part of the graph that nothing else ties to the root, and what each is worth.
CONTEXT_LEVELS = {"prefecture": 400, "county": 200}


def chains(starts: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(start, node) of every unit of ``starts`` (node) with itself and all above it."""
    up = affiliations.select(F.col("subject_node_id").alias("node"), F.col("object_node_id").alias("above"))
    level = settle(starts.select(F.col("node").alias("start"), "node").distinct())
    parts = [level]
    while True:
        level = settle(level.join(up, "node").select("start", F.col("above").alias("node")).join(reduce(DataFrame.unionByName, parts), ["start", "node"], "left_anti").distinct())
        if level.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(level)


def related(dynamic: DataFrame, keyword: str, limit: int) -> DataFrame:
    """The latest relations whose subject, object or evidence holds the keyword, with both ends."""
    names = [F.trim(F.col(c)) for c in ("subject", "object")]
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit("")).contains(keyword) for c in ("subject", "object", "evidence_text")))
    event = (F.col("predicate") == "发生调整") & F.col("object").endswith("事件")
    rows = dynamic.where((names[0] != "") & (names[1] != "") & (F.trim("predicate") != "") & hit & ~event)
    rows = rows.select(names[0].alias("subject"), names[1].alias("object"), F.trim("predicate").alias("relation"), "record_id", "year", "evidence_text")
    return rows.orderBy(F.desc("year"), F.desc("record_id"), "subject", "relation", "object").limit(limit)


def keyword_subgraph(nodes: DataFrame, affiliations: DataFrame, dynamic: DataFrame, keyword: str, children: int = 60, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, category, admin_level, value) and links (source, target, relation, edge_type,
    record_id, year, evidence_text) around a keyword.

    The unit that the keyword names is the root, with its line up to the country, its first ``children``
    units in code order, and up to ``limit`` relations. An end of a relation is the unit of that name if
    it lies under the root, with the line between them, else a text of its own. A part of the graph that
    has no way to the root is tied to the unit that its first evidence names, or to the root. Without
    a unit of that name there is no root, and units anywhere count. dynamic: subject, predicate,
    object, record_id, year, evidence_text. Only ``children`` and ``limit`` bound what is shown; the tables
    are made once and met by equi-joins.
    """
    spark = nodes.sparkSession
    # both are read again and again, and a caller may make them by joins of their own
    nodes = settle(nodes.where("admin_level != 'country'").select("node_id", "admin_code", "admin_name", "admin_level", "full_path"))
    up = settle(affiliations.where("object_node_id != 'CN'").select("subject_node_id", "object_node_id"))
    found = resolve(nodes, "admin_name", "full_path", "admin_code", spark.createDataFrame([(keyword,)], "name string"))
    root = settle(found.join(nodes.select(F.col("admin_code").alias("code"), F.col("node_id").alias("node")), "code").select("node"))
    rooted = root.first()

    rel = settle(related(dynamic, keyword, limit))
    names = rel.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    missing = reduce(lambda a, b: a | b, (F.col("name").startswith(s) for s in STAND_INS))
    own = nodes.select(F.col("admin_name").alias("name"), "admin_code", F.col("node_id").alias("node")).join(names.where(~missing), "name")
    units = own.groupBy("name").agg(F.min_by("node", F.struct(F.length("admin_code"), "admin_code")).alias("node"))
    lines = chains(units, up)
    if rooted:
        # units under the root, or the root itself
        above = settle(chains(root, up).select("node"))
        under = lines.join(root, "node").select(F.col("start").alias("node")).distinct()
        units = units.join(under, "node")
    units = settle(units.select("name", "node"))
    label = F.when(missing, MISSING).otherwise(TEXT)
    ends = settle(names.join(units, "name", "left").select("name", F.coalesce("node", F.concat(F.lit("TEXT::"), "name")).alias("id"), F.col("node").isNotNull().alias("unit"), label.alias("category")))
    a, b = (ends.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")) for c in ("subject", "object"))
    links = rel.join(a, "subject").join(b, "object").where("subject_id != object_id")
    links = links.select(F.col("subject_id").alias("source"), F.col("object_id").alias("target"), "relation", F.lit("dynamic").alias("edge_type"), "record_id", F.col("year").cast("int").alias("year"), "evidence_text")
    once = Window.partitionBy("source", "target", "relation", "record_id").orderBy("evidence_text")
    links = settle(links.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k"))

    shown = lines.join(units.select(F.col("node").alias("start")), "start", "left_semi").select("node")
    if rooted:
        low = shown.join(above, "node", "left_anti").select("node")
        below = up.join(root.select(F.col("node").alias("object_node_id")), "object_node_id").select(F.col("subject_node_id").alias("node_id"))
        below = nodes.join(below, "node_id").orderBy("admin_code", "admin_name").limit(children).select(F.col("node_id").alias("node"))
        shown = low.unionByName(above).unionByName(below)
    shown = settle(shown.distinct())

    def static(shown: DataFrame) -> DataFrame:
        low, high = shown.select(F.col("node").alias("subject_node_id")), shown.select(F.col("node").alias("object_node_id"))
        rows = up.join(low, "subject_node_id").join(high, "object_node_id")
        none = F.lit(None).cast("string")
        return rows.select(F.col("object_node_id").alias("source"), F.col("subject_node_id").alias("target"), F.lit(BELOW).alias("relation"), F.lit("static").alias("edge_type"), none.alias("record_id"), F.lit(None).cast("int").alias("year"), none.alias("evidence_text"))

    all_links = settle(static(shown).unionByName(links))
    if rooted:
        tied = context_links(nodes, up, all_links, links, ends, root, rooted["node"])
        more = chains(tied.select(F.col("source").alias("node")), up).join(above, "node", "left_anti").select("node")
        shown = settle(shown.unionByName(more).distinct())
        all_links = static(shown).unionByName(links).unionByName(tied)
    texts = ends.where(~F.col("unit")).select("id", "name", "category", F.lit(None).cast("string").alias("admin_level"), F.col("name").alias("value"))
    if rooted:
        category = F.when(F.col("node_id") == F.lit(rooted["node"]), ROOT).otherwise(UNIT)
    else:
        category = F.lit(UNIT)
    there = nodes.join(shown.select(F.col("node").alias("node_id")), "node_id")
    there = there.select(F.col("node_id").alias("id"), F.col("admin_name").alias("name"), category.alias("category"), "admin_level", F.col("full_path").alias("value"))
    return there.unionByName(texts), all_links


def context_links(nodes: DataFrame, up: DataFrame, all_links: DataFrame, links: DataFrame, ends: DataFrame, root: DataFrame, root_id: str) -> DataFrame:
    """A link from a unit under the root to each part of the graph that has no way to it."""
    both = all_links.select("source", "target").unionByName(root.select(F.col("node").alias("source"), F.col("node").alias("target")))
    parts = settle(connected_components(both, "source", "target"))
    own = parts.where(F.col("node") == F.lit(root_id)).select("component")
    apart = settle(parts.join(own, "component", "left_anti"))
    # a part's first relation, its nodes and their names
    first = links.join(apart.select(F.col("node").alias("source"), "component"), "source")
    first = settle(first.groupBy("component").agg(F.min(F.struct("year", "record_id", "source", "relation", "target", "evidence_text")).alias("f")).select("component", F.coalesce("f.evidence_text", F.lit("")).alias("evidence")))
    named = apart.join(ends.select(F.col("id").alias("node"), "name", "category"), "node", "left")
    anchor = named.groupBy("component").agg(F.min(F.struct((F.coalesce("category", F.lit("")) != TEXT).alias("other"), F.coalesce("name", "node").alias("name"), "node")).alias("a")).select("component", F.col("a.node").alias("target"))
    units = nodes.where(F.col("admin_level").isin(list(CONTEXT_LEVELS)))
    said = dictionary_matches(first, units.select(F.col("admin_name").alias("name")).where("name != ''"), "evidence", ["component"]).select("component", "name").distinct()
    said = said.join(named.select("component", "name"), ["component", "name"], "left_anti")
    worth = F.create_map(*(F.lit(x) for p in CONTEXT_LEVELS.items() for x in p))
    fit = said.join(units.select(F.col("admin_name").alias("name"), F.col("node_id").alias("node"), "admin_code", "admin_level"), "name")
    fit = settle(fit)
    inside = chains(fit.select("node"), up).join(root.select("node"), "node").select(F.col("start").alias("node")).distinct()
    best = fit.join(inside, "node").groupBy("component").agg(F.max_by("node", F.struct(worth[F.col("admin_level")] + F.length("name"), "admin_code")).alias("source"))
    out = first.join(anchor, "component").join(best, "component", "left").select(F.coalesce("source", F.lit(root_id)).alias("source"), "target")
    none = F.lit(None).cast("string")
    return settle(out.where("source != target").select("source", "target", F.lit(BELOW).alias("relation"), F.lit("context").alias("edge_type"), none.alias("record_id"), F.lit(None).cast("int").alias("year"), none.alias("evidence_text")))
