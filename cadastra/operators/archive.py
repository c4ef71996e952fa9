"""The archive of relation types: how each is told apart, with what the corpus shows for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.relations import ORDER, relation_types, schema_evidence
from cadastra.sources.sinks import markdown_table

# Per relation type, in canonical order, what its subject and object are, its triple, its pattern and a remark.
HINTS = [
    ("REVOKE_ADMIN", "被撤销的旧行政区划", "撤销事件或空对象；若同句有设立，后续可关联新行政区划", "旧行政区划 -> 撤销建制 -> 变更事件", "撤销 + ADMIN_AREA；常与“设立”同句出现。", "高频核心关系，RE 时通常作为事件起点。"),
    ("ESTABLISH_ADMIN", "新设行政区划；上级行政区划常由上下文或区划代码补齐", "设立事件或上级行政区划", "新行政区划 -> 设立建制 -> 变更事件", "设立 + 地级/县级/新的 + ADMIN_AREA；也可能写作“新设”。", "高频核心关系，常与撤销、行政区域承继、政府驻地同句或相邻句出现。"),
    ("RENAME_ADMIN", "旧行政区划名称", "新行政区划名称", "旧行政区划 -> 更名为 -> 新行政区划", "将/把 + ADMIN_AREA + 更名为 + ADMIN_AREA。", "PaddleNLP 中“为”会和“更名”共现，但“为”本身不是名称变更关系。"),
    ("MERGE_ADMIN", "合并前的一个或多个行政区划", "合并后的行政区划", "旧行政区划 -> 合并为 -> 新行政区划", "ADMIN_AREA 列表 + 合并/合并设立/合并组建 + ADMIN_AREA。", "低频但语义明确，下一步 RE 可先支持简单句式。"),
    ("TRANSFER_ADMIN", "被划转的行政区划或区域", "划入后的目标行政区划", "被划转区域 -> 划归 -> 目标行政区划", "将/从 + ADMIN_AREA/区域列表 + 划归/划入 + ADMIN_AREA + 管辖。", "切词有时把“划归”拆成“划/归”，所以触发词表保留拆分形态。"),
    ("JURISDICTION_ADMIN", "上级行政区划", "被管辖的下级行政区划或区域列表", "上级行政区划 -> 管辖 -> 下级行政区划", "ADMIN_AREA + 辖/管辖 + ADMIN_AREA 列表。", "用于构建行政层级和调整后的下辖关系；与划归、直辖、代管存在交叉。"),
    ("DIRECT_ADMIN", "被直辖行政区划", "直接管辖的省级行政区划", "被直辖行政区划 -> 由...直辖 -> 省级行政区划", "ADMIN_AREA + 由 + 省/自治区 + 直辖。", "从管辖类中拆出，便于区分省直管县/县级市等特殊隶属关系。"),
    ("ENTRUST_ADMIN", "被代管行政区划", "代管的地级市或行政区划", "被代管行政区划 -> 由...代管 -> 代管行政区划", "ADMIN_AREA + 由 + ADMIN_AREA + 代管。", "与直辖类似，属于管辖关系的特殊形态。"),
    ("GOV_RESIDENCE", "人民政府机构或对应行政区划", "驻地地址或驻地行政区划", "人民政府/行政区划 -> 政府驻地 -> 地址或行政区划", "ORG/GOV_ORG + 驻 + ADDRESS/ADMIN_AREA。", "“驻”频次很高，其中一部分只是说明新设地区的驻地，不一定表示迁移。"),
    ("RESIDENCE_TRANSFER", "人民政府驻地或对应行政区划", "新驻地；若有“由”，可同时抽取旧驻地", "人民政府/行政区划 -> 驻地迁至 -> 新驻地", "人民政府驻地由 + OLD_LOCATION + 迁至/迁移至 + NEW_LOCATION。", "属于政府驻地关系的变更型子类，优先单独抽取。"),
    ("AREA_INHERITANCE", "新行政区划", "原行政区划或原行政区域", "新行政区划 -> 承继行政区域 -> 原行政区划", "以 + 原ADMIN_AREA + 的行政区域 + 为 + 新ADMIN_AREA + 的行政区域。", "“为”是高频辅助词，不能直接当关系；只有落在该句式中才归入本类。"),
    ("ADJUSTMENT_EVENT", "被调整的行政区划或区域", "调整事件；具体对象由划归/管辖/设立等子关系补充", "行政区划/区域 -> 发生调整 -> 变更事件", "调整 + ADMIN_AREA + 行政区划；后文常出现多个子关系。", "建议作为事件路由标签，不强行当作单一二元关系。"),
    ("SCOPE_CONSTRAINT", "被描述的行政区域范围", "被包含或排除的区域", "行政区域范围 -> 包含/排除 -> 区域", "括号或补充说明中的“不含/包括/除外”。", "不是主关系，但对精细化区域边界很有用，下一步可先作为修饰信息。"),
]
FIELDS = "relation_type_id string, subject_hint string, object_hint string, triple_template string, pattern_hint string, notes string"


def relation_archive(spark: SparkSession) -> DataFrame:
    """The 13 relation types with triggers, hints and their place in the canonical order."""
    hints = spark.createDataFrame(HINTS, FIELDS)
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("relation_type_id")).cast("int")
    return relation_types(spark).join(hints, "relation_type_id").withColumn("schema_order", place)


def archive_with_evidence(sents: DataFrame, verbs: DataFrame, text: str = "sentence") -> DataFrame:
    """The archive with the tokens of each type's triggers (``verbs``: verb, count) and the sentences in
    which its pattern is found."""
    return schema_evidence(sents, verbs, relation_archive(sents.sparkSession), text)


def archive_document(archive: DataFrame, title: str = "Relation types") -> str:
    """The archive (13 rows) as a Markdown document: a table of all types, then a section for each."""
    rows = archive.orderBy("schema_order")
    short = rows.select("relation_type_id", "relation_type_name", "relation_group", "re_status", F.array_join("triggers", "、").alias("triggers"), *(c for c in ("trigger_count", "evidence_sentence_count") if c in archive.columns))
    parts = [f"# {title}", markdown_table(short)]
    for r in rows.collect():
        parts.append(
            f"## {r['relation_type_id']} {r['relation_type_name']}\n\n"
            f"- subject: {r['subject_hint']}\n- object: {r['object_hint']}\n- triple: {r['triple_template']}\n- pattern: {r['pattern_hint']}\n- remark: {r['notes']}"
        )
    return "\n\n".join(parts) + "\n"
