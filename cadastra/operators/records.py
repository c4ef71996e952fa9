"""Change records: the sentences and triples of one item folded together, and edges derived from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadastra.functions.text import admin_code, canonical, clean_cell, code_level, join_distinct
from cadastra.operators.notices import dense_ids
from cadastra.operators.relations import FALLBACK, NAMES, ORDER, is_publication_notice

# Actions and predicates by relation type, and how texts name units.
ACTIONS = {
    "RENAME_ADMIN": "更名", "MERGE_ADMIN": "合并", "REVOKE_ADMIN": "撤销", "ESTABLISH_ADMIN": "设立", "TRANSFER_ADMIN": "划归",
    "JURISDICTION_ADMIN": "隶属", "DIRECT_ADMIN": "直辖", "ENTRUST_ADMIN": "代管", "RESIDENCE_TRANSFER": "驻地迁移", "GOV_RESIDENCE": "政府驻地",
    "AREA_INHERITANCE": "区域承继", "ADJUSTMENT_EVENT": "调整", "SCOPE_CONSTRAINT": "范围约束",
}
#: relation: (predicate, whether object and subject change places)
PREDICATES = {
    "RENAME_ADMIN": ("变更为", False), "AREA_INHERITANCE": ("变更为", True), "MERGE_ADMIN": ("合并为", False), "TRANSFER_ADMIN": ("划归", False),
    "JURISDICTION_ADMIN": ("隶属于", True), "DIRECT_ADMIN": ("直辖于", False), "ENTRUST_ADMIN": ("代管于", False),
    "RESIDENCE_TRANSFER": ("驻地迁至", False), "GOV_RESIDENCE": ("政府驻地", False), "ADJUSTMENT_EVENT": ("发生调整", False), "SCOPE_CONSTRAINT": ("范围约束", False),
}
#: Which side of a triple is an old and which a new unit.
OLD_SUBJECT = ["REVOKE_ADMIN", "RENAME_ADMIN", "MERGE_ADMIN", "TRANSFER_ADMIN", "DIRECT_ADMIN", "ENTRUST_ADMIN"]
OLD_OBJECT = ["AREA_INHERITANCE", "JURISDICTION_ADMIN"]
NEW_SUBJECT = ["AREA_INHERITANCE", "JURISDICTION_ADMIN", "ESTABLISH_ADMIN"]
NEW_OBJECT = ["RENAME_ADMIN", "MERGE_ADMIN", "TRANSFER_ADMIN", "DIRECT_ADMIN", "ENTRUST_ADMIN", "GOV_RESIDENCE", "RESIDENCE_TRANSFER"]
GONE, CREATED = "无新区划（撤销）", "无旧区划（新设）"
SUPPLEMENTS = {
    "TEXT_UNIT_TRANSFER": "TRANSFER_ADMIN", "TEXT_UNIT_JURISDICTION": "JURISDICTION_ADMIN", "TEXT_RESIDENCE_TRANSFER": "RESIDENCE_TRANSFER", "TEXT_GOV_RESIDENCE": "GOV_RESIDENCE",
}
# How texts name units, and what they say of them.
UNIT_ENDS = "街道办事处|村委会|居委会|街道|社区|苏木|镇|乡|村"
UNITS = "([一-龥、和及与]+?)(?:[0-9一二三四五六七八九十百]+个)?(街道办事处|村委会|居委会|街道|社区|苏木|镇|乡|村)"
TRANSFER = "将(.+?)划归([一-龥]{2,30}(?:区|县|市|旗|盟|地区|自治州))管辖"
GOVERNS = "([一-龥]{2,20}(?:区|县|市|旗|盟|地区|自治州))[:：]?辖([^。；;]+)"
MOVED_SEAT = "驻地由(.+?)(?:迁移至|迁至|迁移)([^。；;]+)"
SEAT = "([一-龥]{2,20}(?:区|县|市|旗|盟|地区|自治州))人民政府驻(?!地)([^。；;]+)"
RENAMED = "([一-龥]{2,20}[市县区旗])更名为([一-龥]{2,20}[市县区旗])"
REVOKED = "撤销([一-龥]{2,20}[市县区旗盟州地区])"
CREATED_BY = "设立(?:地级|县级|新的)?([一-龥]{2,20}[市县区旗盟州地区])"
NO_UNITS = ["公路", "国道", "铁路", "界线", "区域"]
NO_SEATS = ["迁至", "迁移", "驻地由"]

_BRACKETS = re.compile("[（(].*?[）)]")
_COUNT = re.compile("[0-9一二三四五六七八九十百]+个$")
_BETWEEN = re.compile("[、,，]|以及|和|及|与")
#: What precedes a name in its item of a list: 并, all up to the last 的 and then up to the last 驻地.
_BEFORE_NAME = re.compile("^(?:并(?=.))?(?:.*的)?(?:.*驻地)?", re.S)
_ENDED = re.compile(f"(?:{UNIT_ENDS})$")


def list_items(text: str) -> Iterator[tuple[str, str]]:
    """(item, ending of its list) of every list of units, as 'A、B和C3个街道' has A, B and C with 街道."""
    for names, ending in re.findall(UNITS, _BRACKETS.sub("", text)):
        for item in _BETWEEN.split(_COUNT.sub("", names)):
            yield _BEFORE_NAME.sub("", item.strip(" ，。；;、:：")), ending


def unit_names(text: str) -> list[str]:
    """Units that a text lists, each with an ending, in order and without repeats."""
    named = (item if not item or _ENDED.search(item) else item + ending for item, ending in list_items(text))
    return list(dict.fromkeys(n for n in named if len(n) > 1 and not any(w in n for w in NO_UNITS)))


def place(text: str) -> str:
    """The last unit of a description, or the description without brackets."""
    plain = _BRACKETS.sub("", text.strip()).strip(" ，。；;、")
    return next(reversed(unit_names(plain)), plain)


def _whole(text: str) -> list[str]:
    return [text]


def _place(text: str) -> list[str]:
    return [place(text)]


#: Kind of statement: pattern, whether its first group is the subject, predicate, and how each of the
#: subject's and the object's text is read.
STATEMENTS = {
    "TEXT_UNIT_TRANSFER": (TRANSFER, True, "划归", unit_names, _whole),
    "TEXT_UNIT_JURISDICTION": (GOVERNS, False, "隶属于", unit_names, _whole),
    "TEXT_RESIDENCE_TRANSFER": (MOVED_SEAT, True, "驻地迁至", _place, _place),
    "TEXT_GOV_RESIDENCE": (SEAT, True, "政府驻地", _whole, _place),
}


def supplements(text: str) -> list[tuple[str, str, str, str, str]]:
    """(subject, predicate, object, kind, evidence) that a record's text says outright."""
    out = []
    for kind, (pattern, first, predicate, subjects, objects) in STATEMENTS.items():
        for m in re.finditer(pattern, text):
            a, b = m.groups() if first else m.groups()[::-1]
            out += [(s, predicate, o, kind, m[0]) for s in subjects(a) for o in objects(b) if s and o]
    return [s for s in out if s[3] != "TEXT_GOV_RESIDENCE" or not any(w in s[2] for w in NO_SEATS)]


def mentioned(text: str) -> list[tuple[str, str, str]]:
    """(old unit, new unit, action), '' for none, from set phrases, then from ``supplements``."""
    out = [(a, b, "更名") for a, b in re.findall(RENAMED, text)]
    out += [(a, "", "撤销") for a in re.findall(REVOKED, text)]
    out += [("", b, "设立") for b in re.findall(CREATED_BY, text)]
    return out + [(a, b, p) for a, p, b, _, _ in supplements(text)]


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["said"] = [[list(x) for x in mentioned(t or "")] for t in pdf["record_text"]]
        pdf["more"] = [[list(x) for x in supplements(t or "")] for t in pdf["record_text"]]
        yield pdf


def record_key() -> Column:
    item = clean_cell(F.col("item_no"))
    return F.concat_ws("::", clean_cell(F.col("source_file")), F.when(item != "", item).otherwise(clean_cell(F.col("sentence_id"))))


def _admin(x: str) -> Column:
    """A triple's side where it is a unit: not an event and not a stand-in for none."""
    text = clean_cell(F.col(x))
    return F.when(text.endswith("事件") | text.startswith("无旧区划") | text.startswith("无新区划"), "").otherwise(text)


def build_records(sents: DataFrame, triples: DataFrame) -> DataFrame:
    """One row per item: its text without mere announcements, old and new units and actions in order
    of appearance, relation types in canonical order, and a confidence.

    Both sides are folded to one row per record before they meet, so the join moves no sentence twice.
    """
    content = sents.withColumn("record_key", record_key()).where(~is_publication_notice())
    item = F.struct("line_no", "sentence_id", "sentence")
    texts = content.groupBy("source_file", "record_key", "year", "item_no").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    texts = texts.withColumns(
        {"record_text": F.array_join(F.transform("_s", lambda s: clean_cell(s["sentence"])), ""), "sentence_ids": join_distinct(F.col("_s.sentence_id")), "first_line": F.get("_s", F.lit(0))["line_no"]}
    ).drop("_s")
    lists = T.ArrayType(T.ArrayType(T.StringType()))
    schema = T.StructType([*texts.schema.fields, T.StructField("said", lists), T.StructField("more", lists)])
    texts = texts.mapInPandas(_texts, schema)
    kind, subject, object_ = F.col("relation_type_id"), _admin("subject_text"), _admin("object_text")
    side = lambda x, kinds: F.when(kind.isin(kinds), x)
    action = F.coalesce(*(F.when(kind == k, v) for k, v in ACTIONS.items()), clean_cell(F.col("trigger_text")))
    fold = F.struct(
        "sentence_id",
        "emit_no",
        F.array_compact(F.array(side(subject, OLD_SUBJECT), side(object_, OLD_OBJECT))).alias("old"),
        F.array_compact(F.array(side(subject, NEW_SUBJECT), side(object_, NEW_OBJECT))).alias("new"),
        action.alias("action"),
    )
    per = triples.withColumn("record_key", record_key()).groupBy("record_key").agg(
        F.array_sort(F.collect_list(fold)).alias("_t"), F.collect_set("relation_type_id").alias("_types"), F.avg(F.col("confidence").cast("decimal(9,4)")).alias("_c")
    )
    said = lambda k: F.transform("said", lambda x: F.element_at(x, k))
    folded = lambda k: F.coalesce(F.flatten(F.transform("_t", lambda x: x[k])), F.array().cast("array<string>"))
    df = texts.join(per, "record_key", "left")
    types = canonical(F.coalesce("_types", F.array().cast("array<string>")), ORDER, FALLBACK)
    df = df.withColumn("_ids", types)
    did = F.filter(F.concat(F.coalesce(F.transform("_t", lambda x: x["action"]), F.array().cast("array<string>")), said(3)), lambda x: x != "")
    only = (F.size("_ids") == 1) & (F.get("_ids", F.lit(0)) == FALLBACK)
    label = F.transform("_ids", lambda i: F.element_at(F.create_map(*(F.lit(x) for p in NAMES.items() for x in p)), i))
    return df.select(
        "record_key",
        "source_file",
        "year",
        F.concat(F.col("year").cast("string"), F.lit("年")).alias("effective_time"),
        "item_no",
        "first_line",
        "sentence_ids",
        "record_text",
        join_distinct(F.concat(folded("old"), said(1))).alias("before_entities"),
        join_distinct(F.concat(folded("new"), said(2))).alias("after_entities"),
        join_distinct(F.when(only & (F.size(did) == 0), F.array(F.lit("调整"))).otherwise(did)).alias("action_keywords"),
        join_distinct(label).alias("type_label"),
        F.when(F.col("_types").isNull() & only, 0.6).otherwise(F.coalesce(F.bround("_c", 4).cast("double"), F.lit(0.9))).alias("classification_confidence"),
        F.when(F.col("_types").isNull(), "无细粒度关系，归入综合事件").otherwise("RE 关系类型集合").alias("classification_rule"),
        F.array_join("_ids", " / ").alias("relation_type_ids"),
        "more",
    )


def numbered_records(records: DataFrame) -> DataFrame:
    return dense_ids(records, ["source_file", "first_line", "record_key"], "record_id", "CR%06d")


def dynamic_triples(records: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges over time of every record: pairs of revoked and established units, each triple by its
    predicate, stand-ins for what has no counterpart, and what the text adds. Of the same
    (record, subject, predicate, object) the first in that order stays. Blank or equal ends are left out.
    """
    t = triples.withColumns({"record_key": record_key(), "s": _admin("subject_text"), "o": _admin("object_text")})
    kind, raw = F.col("relation_type_id"), clean_cell(F.col("object_text"))
    order = F.struct("sentence_id", "emit_no")
    side = lambda k: F.array_sort(F.collect_list(F.when(kind == k, F.struct("sentence_id", "emit_no", "s"))))
    per = t.groupBy("record_key").agg(
        side("REVOKE_ADMIN").alias("old"), side("ESTABLISH_ADMIN").alias("new"), F.array_sort(F.collect_set(F.struct("line_no", "sentence_id", "sentence"))).alias("_e")
    )
    evidence = join_distinct(F.col("_e.sentence"))
    edge = lambda s, p, o, source, rank, pos: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(source).alias("source_relation_type"), F.lit(rank).alias("part"), pos.cast("int").alias("pos"))
    # a record's own revoked times established units: as small as a notice's item
    both = F.flatten(F.transform("old", lambda a, i: F.transform("new", lambda b, j: edge(a["s"], "变更为", b["s"], "REVOKE_ADMIN+ESTABLISH_ADMIN", 0, i * 1000 + j))))
    gone = F.transform("old", lambda a, i: edge(a["s"], "撤销", F.lit(GONE), "REVOKE_ADMIN", 2, i))
    made = F.transform("new", lambda b, j: edge(F.lit(CREATED), "设立", b["s"], "ESTABLISH_ADMIN", 2, j))
    pairs = F.when((F.size("old") > 0) & (F.size("new") > 0), both).when(F.size("old") > 0, gone).otherwise(made)
    first = per.select("record_key", evidence.alias("evidence_text"), F.lit("").alias("sid"), F.inline(pairs))
    plain = None
    for k, (predicate, swap) in PREDICATES.items():
        object_ = raw if k == "ADJUSTMENT_EVENT" else F.col("o")
        a, b = (object_, F.col("s")) if swap else (F.col("s"), object_)
        now = F.struct(a.alias("subject"), F.lit(predicate).alias("predicate"), b.alias("object"))
        plain = F.when(kind == k, now) if plain is None else plain.when(kind == k, now)
    seat = kind != "GOV_RESIDENCE"
    fine = ~F.col("o").isin("地", "地迁移") & ~F.col("o").rlike("迁至|迁移") & ~F.coalesce("evidence_text", F.lit("")).rlike("驻地由|迁至")
    each = t.where(seat | fine).select("record_key", "evidence_text", F.col("sentence_id").alias("sid"), "emit_no", kind.alias("source_relation_type"), plain.alias("e")).where("e is not null")
    each = each.select("record_key", "evidence_text", "sid", "e.*", "source_relation_type", F.lit(1).alias("part"), F.col("emit_no").cast("int").alias("pos"))
    more = records.select("record_key", F.posexplode("more").alias("pos", "m"))
    at = lambda k: F.element_at("m", k)
    more = more.select(
        "record_key", at(5).alias("evidence_text"), F.lit("").alias("sid"), at(1).alias("subject"), at(2).alias("predicate"), at(3).alias("object"), at(4).alias("source_relation_type"), F.lit(3).alias("part"), "pos"
    )
    rows = first.unionByName(each).unionByName(more).where("subject != '' and object != '' and subject != object")
    once = Window.partitionBy("record_key", "subject", "predicate", "object").orderBy("part", "sid", "pos")
    rows = rows.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k")
    source = F.col("source_relation_type")
    ids = F.coalesce(*(F.when(source == k, F.array(F.lit(v))) for k, v in SUPPLEMENTS.items()), canonical(F.split(source, r"\+"), ORDER, FALLBACK))
    label = F.element_at(F.create_map(*(F.lit(x) for p in NAMES.items() for x in p)), F.get(ids, F.lit(0)))
    rows = rows.join(records.select("record_key", "record_id", "year", "effective_time", "type_label"), "record_key")
    return rows.withColumns({"relation_type_ids": F.array_join(ids, " / "), "first_type_label": label})


def static_nodes(areas: DataFrame, townships: DataFrame | None = None) -> DataFrame:
    """The country and every unit of the code tables (code, name: comma path) as nodes."""
    def of(df: DataFrame, width: int, source: str, level: Column | None) -> DataFrame:
        parts = F.filter(F.transform(F.split("name", ","), lambda p: F.trim(p)), lambda p: (p != "") & (p != "中国"))
        df = df.select(admin_code(F.col("code"), width).alias("admin_code"), parts.alias("p")).where("admin_code != '' and size(p) > 0")
        at = lambda k: F.coalesce(F.get("p", F.lit(k)), F.lit(""))
        return df.select(
            F.concat(F.lit("ADM_"), "admin_code").alias("node_id"), "admin_code", F.element_at("p", -1).alias("admin_name"),
            (level if level is not None else code_level(F.col("admin_code"))).alias("admin_level"),
            at(0).alias("province"), at(1).alias("prefecture"), at(2).alias("county"), F.concat(F.lit("中国/"), F.array_join("p", "/")).alias("full_path"), F.lit(source).alias("source_table"),
        )

    out = of(areas, 6, "省市区", None)
    if townships is not None:
        out = out.unionByName(of(townships, 9, "乡镇街道", F.lit("township")))
    first = Window.partitionBy("node_id").orderBy("source_table", "full_path")
    out = out.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    root = out.sparkSession.createDataFrame([("CN", "CN", "中国", "country", "", "", "", "中国", "system")], out.schema)
    return root.unionByName(out)


def static_affiliations(nodes: DataFrame, version: str = "") -> DataFrame:
    """An edge from every unit to its parent by code prefix: county, prefecture, province, country,
    whichever is there first."""
    code, level = F.col("admin_code"), F.col("admin_level")
    chain = F.array(F.when(level == "township", F.substring(code, 1, 6)), F.when(level.isin("township", "county"), F.concat(F.substring(code, 1, 4), F.lit("00"))), F.when(level != "province", F.concat(F.substring(code, 1, 2), F.lit("0000"))))
    units = nodes.where("node_id != 'CN'")
    tries = units.select("node_id", F.posexplode(chain).alias("k", "parent_code")).where("parent_code is not null")
    known = nodes.select(F.col("admin_code").alias("parent_code"), F.col("node_id").alias("parent_id"), F.col("admin_name").alias("parent_name"))
    best = tries.join(known, "parent_code").where("parent_id != node_id").groupBy("node_id").agg(F.min_by(F.struct("parent_id", "parent_name"), "k").alias("p"))
    return units.join(best, "node_id", "left").select(
        F.col("node_id").alias("subject_node_id"), code.alias("subject_code"), F.col("admin_name").alias("subject_name"), F.lit("隶属于").alias("predicate"),
        F.coalesce("p.parent_id", F.lit("CN")).alias("object_node_id"), F.coalesce("p.parent_name", F.lit("中国")).alias("object_name"), "source_table", F.lit(version).alias("version_date"),
    )


def record_entities(records: DataFrame) -> DataFrame:
    """Records as they are shown: units before and after, types and actions."""
    return records.select(
        "record_id", "year", "record_text", F.col("before_entities").alias("变更前实体"), F.col("after_entities").alias("变更后实体"),
        F.col("type_label").alias("变更类型"), F.col("action_keywords").alias("变更动作关键词"), F.col("classification_confidence").alias("置信度"),
    )
