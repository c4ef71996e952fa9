"""Six classes over the 13 relation types, filters by either, and how units are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.text import canonical, split_list
from cadastra.operators.labels import capped, cover_labels, evaluation, hash_split, train_and_predict
from cadastra.operators.records import SUPPLEMENTS
from cadastra.operators.relations import FALLBACK, NAMES, ORDER

# Classes in order with their relation types; levels, their names and other names; sources of counts.
CLASSES = {
    "建制变更": ["REVOKE_ADMIN", "ESTABLISH_ADMIN", "MERGE_ADMIN"],
    "名称变更": ["RENAME_ADMIN"],
    "管辖隶属调整": ["JURISDICTION_ADMIN", "DIRECT_ADMIN", "ENTRUST_ADMIN"],
    "区域划转": ["TRANSFER_ADMIN", "AREA_INHERITANCE", "SCOPE_CONSTRAINT"],
    "驻地变更": ["GOV_RESIDENCE", "RESIDENCE_TRANSFER"],
    "其他综合调整": ["ADJUSTMENT_EVENT"],
}
LEVEL_NAMES = {
    "country": "国家", "province": "省级", "prefecture": "地市级", "city": "地市级", "county": "县区级", "township": "乡镇街道级", "town": "乡镇街道级",
}
PAGE_LEVELS = {"prefecture": "city", "township": "town"}
LEVELS = {"province": "province", "prefecture": "prefecture", "city": "prefecture", "county": "county", "town": "township", "township": "township"}
YEARBOOK_SOURCE, YEARBOOK = "nbs_yearbook_province_admin_", "国家统计局《中国统计年鉴》1-1 全国行政区划省级表（{}年底）"
SOURCES = {
    "gaohr_cn_streets_csv_from_nbs_statistical_division_codes": "GaoHR 整理的国家统计局统计用区划代码乡级 CSV（2017-2023）",
    "linear_interpolation_between_nbs_yearbook_and_statistical_division_counts": "线性插值：连接官方年鉴省级表与统计用区划代码统计值",
    "statistical_forecast_from_2009_2023_counts_with_external_regressors": "统计预测：历史数量趋势 + 外部回归因子",
}
SOURCE_BEGINNINGS = {
    "carried_forward_from_": "现势估计：沿用最新统计用区划代码省级统计值",
    "statistical_forecast_from_": "统计预测：基于历史省级数量序列的阻尼 Huber 趋势",
}
NO_SOURCE = "未标注来源"

OTHER = "其他综合调整"
CLASS_OF = {t: c for c, types in CLASSES.items() for t in types}
ID_OF = {name: t for t, name in NAMES.items()}


def _mapped(x: Column, table: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), x), otherwise)


def relation_ids(source: Column, labels: Column) -> Column:
    """Relation types of an edge, in canonical order: those of its source (joined by +, or a kind of
    supplement), else those that its type label names (joined by /), else the fallback."""
    named = F.transform(split_list(labels), lambda x: _mapped(x, ID_OF, F.lit("")))
    known = canonical(F.transform(split_list(source, "+"), lambda x: _mapped(x, SUPPLEMENTS, x)), ORDER)
    return F.when(F.size(known) > 0, known).otherwise(canonical(named, ORDER, FALLBACK))


def classes_of(ids: Column) -> Column:
    """Classes of relation types in order, without repeats; unknown types are of the last class."""
    found = F.transform(ids, lambda t: _mapped(t, CLASS_OF, F.lit(OTHER)))
    return F.filter(F.array(*map(F.lit, CLASSES)), lambda c: F.array_contains(found, c))


def classes_of_labels(labels: Column) -> Column:
    """Classes of type names joined by /."""
    return classes_of(F.transform(split_list(labels), lambda x: _mapped(x, ID_OF, F.lit(""))))


def view_of(value: object) -> str:
    """semantic or detail, from what a caller writes for it."""
    return "semantic" if str(value or "").strip().lower() in ("semantic", "sem", "aggregate", "aggregation") else "detail"


def type_filter(value: object, view: str = "detail") -> str:
    """A type's name (detail) or a class (semantic) from a name, an id or a class; '' for none.

    In the semantic view a name, or names joined by /, give their first class; other text is kept."""
    text = str(value or "").strip()
    if view_of(view) == "detail":
        return text if text in ID_OF else NAMES.get(text, "")
    if text in CLASSES or not (text in ID_OF or "/" in text):
        return text
    found = {CLASS_OF.get(ID_OF.get(x.strip(), ""), OTHER) for x in text.split("/") if x.strip()}
    return next((c for c in CLASSES if c in found), OTHER)


def type_names(value: object, view: str = "detail") -> list[str]:
    """Type names that a filter stands for, sorted; none where it stands for nothing known."""
    wanted = type_filter(value, view)
    if view_of(view) == "detail":
        return [wanted] if wanted else []
    if wanted in CLASSES:
        return sorted(NAMES[t] for t in CLASSES[wanted])
    text = str(value or "").strip()
    return [text] if text in ID_OF else []


def with_type(df: DataFrame, value: object, view: str = "detail", labels: str = "type_label") -> DataFrame:
    """Rows whose type label holds one of the filter's names; all rows without a filter."""
    if not type_filter(value, view):
        return df
    return df.where(F.arrays_overlap(split_list(F.col(labels)), F.array(*map(F.lit, type_names(value, view))).cast("array<string>")))


def type_distribution(counts: DataFrame, view: str = "detail", labels: str = "type_label", value: str = "value") -> DataFrame:
    """Counts by type name, or by class with all six, from counts by type labels joined by /.

    A label of several types counts for each of them, of several types of a class once for it."""
    by = classes_of_labels(F.col(labels)) if view_of(view) == "semantic" else F.array_distinct(split_list(F.col(labels)))
    sums = counts.select(F.explode(by).alias("type"), F.col(value).alias("n")).groupBy("type").agg(F.sum("n").alias(value))
    if view_of(view) == "detail":
        return sums
    spine = counts.sparkSession.createDataFrame([(c,) for c in CLASSES], "type string")  # six rows
    return F.broadcast(spine).join(sums, "type", "left").withColumn(value, F.coalesce(value, F.lit(0)))


def six_class_records(records: DataFrame, ids: str = "relation_type_ids") -> DataFrame:
    """``records`` with ``label_set``, their classes, from relation types joined by /."""
    return records.withColumn("label_set", classes_of(split_list(F.col(ids))))


def six_class_split(records: DataFrame, per_class: int, key: str = "record_id", share: float = 0.2) -> DataFrame:
    """``six_class_records`` with is_test and is_sample: of the training side the first ``per_class`` of each
    class, those with few classes first."""
    split = cover_labels(hash_split(six_class_records(records), key, share), "label_set", key)
    chosen = capped(split.where("not is_test"), "label_set", per_class, [key]).select(key, F.lit(True).alias("_c"))
    return split.join(chosen, key, "left").withColumn("is_sample", F.coalesce("_c", F.lit(False))).drop("_c")


def six_class_evaluation(records: DataFrame, per_class: int, key: str = "record_id", text: str = "record_text", share: float = 0.2) -> DataFrame:
    """Scores of a six-class classifier on the test side, learned from the balanced sample only, and how
    often it agrees with the rules on all records."""
    split = six_class_split(records, per_class, key, share)
    got = train_and_predict(split, key, text, "label_set", list(CLASSES), learn=split.where("is_sample").select(key), is_test="is_test")
    one = lambda df: evaluation(df, "label_set", "predicted", list(CLASSES)).withColumn("_one", F.lit(1))
    whole = one(got).select("_one", F.col("exact_match_accuracy").alias("rule_ml_agreement_rate"), F.col("label_accuracy").alias("full_label_accuracy"))
    counts = split.agg(F.count("*").alias("total_labeled_sample_count"), F.count_if("is_sample").alias("training_sample_count"), F.lit(1).alias("_one"))
    return one(got.where("is_test")).join(whole, "_one").join(counts, "_one").drop("_one")  # a row each


def level_name(level: Column) -> Column:
    return _mapped(level, LEVEL_NAMES, F.coalesce(level, F.lit("")))


def page_level(level: Column) -> Column:
    return _mapped(level, PAGE_LEVELS, F.coalesce(level, F.lit("")))


def level_set(levels: str) -> list[str]:
    """Levels that a comma list names, in any of their names; none means all."""
    return sorted({LEVELS.get(x.strip(), x.strip()) for x in levels.split(",") if x.strip()})


def area_text(x: Column) -> Column:
    """A path or name for comparison: without blanks, slashes and the country's name."""
    return F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[/ \t\n\r]", ""), F.lit("中国"), F.lit(""))


def area_rows(nodes: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Units as they are shown: code, name, level, level_name, parent_code, full_path, source_table."""
    up = affiliations.select(F.col("subject_node_id").alias("node_id"), F.col("object_node_id").alias("_p"))
    codes = nodes.select(F.col("node_id").alias("_p"), F.col("admin_code").alias("parent_code"))
    level = F.col("admin_level")
    return nodes.join(up, "node_id", "left").join(codes, "_p", "left").select(
        F.col("admin_code").alias("code"), F.col("admin_name").alias("name"), page_level(level).alias("level"), level_name(level).alias("level_name"), "parent_code", "full_path", "source_table"
    )


def township_source(source: Column) -> Column:
    """What a panel says of where a count comes from, by its source's id."""
    known = _mapped(source, SOURCES, F.lit(None).cast("string"))
    begun = F.coalesce(*(F.when(source.startswith(k), F.lit(v)) for k, v in SOURCE_BEGINNINGS.items()))
    before, after = YEARBOOK.split("{}")
    yearbook = F.when(source.startswith(YEARBOOK_SOURCE), F.concat(F.lit(before), F.substring_index(source, "_", -1), F.lit(after)))
    return F.when(F.coalesce(source, F.lit("")) == "", NO_SOURCE).otherwise(F.coalesce(yearbook, known, begun, source))
