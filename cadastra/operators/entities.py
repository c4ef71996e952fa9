"""Entities of change notices: a dictionary join, pattern spans and the greedy choice among overlaps.

The dictionary is a table that is joined, never a closure: substrings of its lengths are looked up, and
so is every step of a pattern match from which leading words are stripped one after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.text import code_level
from cadastra.operators.notices import dense_ids

# The vocabulary of administrative names and of the words around them.
STOP_NAMES = ["中国", "市辖区", "行政区", "行政区域", "辖区", "特别行政区", "维吾尔自治区"]
SUFFIXES = [
    "特别行政区", "维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "自治州", "自治县", "自治旗", "民族乡", "开发区", "管理区", "矿区",
    "林区", "新区", "特区", "地区", "街道", "苏木", "省", "市", "区", "县", "旗", "镇", "乡", "盟",
]
LEADING = [
    "将其管辖的", "将管辖的", "将所辖", "其管辖的", "管辖的", "代管的", "所辖", "驻新设立的", "驻新设的", "新设立的", "新设的", "新组建的",
    "原县级", "原地级", "原省级", "县级", "地级", "省级", "更名为", "改设为", "改为", "迁移至", "迁至", "划归", "划入", "划出", "撤销", "设立",
    "增设", "调整", "原属", "驻地由", "不含", "不包括", "包括", "以及", "管辖原", "管辖", "辖原", "辖", "的", "由", "以",
]
LEADING_IF_NAME = ["将", "原"]
LEADING_CONJUNCTIONS = ["和", "及", "与"]
NOISE_STARTS = ["撤销", "设立", "调整", "将", "以", "由", "其", "并入", "划归", "管辖", "代管", "更名", "批准"]
NOT_IN_NAMES = [
    "人民政府", "行政区域", "部分区域", "所辖区域", "所辖区", "委员会", "办事处", "居委会", "村委会", "划归", "管辖", "迁至", "迁移", "驻地",
    "为界", "公路", "铁路", "国道", "所属",
]
DIRECTIONS = ["东起", "西至", "南起", "北至"]
RESIDENCE_MARKS = ["人民政府驻", "政府驻", "驻地迁至", "驻地由", "迁移至", "迁至", "驻"]
RESIDENCE_LEFT = ["驻", "迁至", "驻地", "治所"]
COUNTED = "[0-9一二三四五六七八九十百千万]+个(?:街道|镇|乡|村|区|县|旗|苏木)"
NAME_PATTERN = re.compile("[一-鿿]{1,30}?(?:" + "|".join(SUFFIXES) + ")")
OFFICE_PATTERN = re.compile("[一-鿿]{0,20}(?:人民政府|民政部|国务院)")
ADDRESS_PATTERN = re.compile(r"[一-鿿A-Za-z0-9]{1,35}(?:大道|大街|街道|路|街|巷|弄)[一-鿿A-Za-z0-9\-]*号?")
#: method: (priority, confidence, confidence where the name is in the dictionary)
METHODS = {
    "lexicon_exact": (100, 0.97, 0.99),
    "regex_admin_area": (75, 0.72, 0.86),
    "paddle_uie": (70, 0.7, 0.7),
    "regex_government_org": (55, 0.78, 0.78),
    "regex_address": (50, 0.68, 0.68),
}
EDGE = " \t\r\n，。；、：（）()"


def valid(text: str) -> bool:
    """Whether a text can be an entity at all: long enough and none of the general phrases."""
    text = text.strip(" ，。；、（）()")
    general = text in STOP_NAMES or text[:1] in "的和及与" and text[1:] in STOP_NAMES
    tail = text.endswith("行政区域") or text.endswith("行政区") and not text.endswith("特别行政区")
    phrases = any(p in text for p in ("部分区", "如下", "情况", "同意", "批复"))
    return len(text) >= 2 and not (general or tail or phrases or text.startswith(("个", "部分")) or re.search(COUNTED, text))


def stripped(text: str, start: int) -> list[tuple[str, int]]:
    """A matched text and what is left after each leading word taken off, with its place.

    Whoever knows the dictionary takes the first that is in it, else the last."""
    chain = [(text.strip(EDGE), start)]
    by_length = sorted(LEADING, key=len, reverse=True)
    while True:
        now, at = chain[-1]
        longest = next((p for p in by_length if now.startswith(p) and len(now) > len(p) + 1), None)
        if longest is None:
            longest = next((p for p in LEADING_IF_NAME if now.startswith(p) and len(now) > len(p) + 1 and now[len(p) :].endswith(tuple(SUFFIXES))), None)
        if longest is None:
            rest = [p for p in LEADING_CONJUNCTIONS if now.startswith(p) and len(now) > len(p) + 1]
            longest = next((p for p in rest if now[len(p) :].endswith(tuple(SUFFIXES)) and valid(now[len(p) :])), None)
        if longest is None:
            return chain
        chain.append((now[len(longest) :].strip(EDGE), at + len(longest)))


def _area_ok(text: str, following: str) -> bool:
    wrong = any(p in text for p in NOT_IN_NAMES) or text.startswith(tuple(DIRECTIONS))
    return valid(text) and text.endswith(tuple(SUFFIXES)) and not wrong and not _cut_short(text, following)


def _cut_short(name: str, following: str) -> bool:
    return following == "级" or name == "和县" and following == "的"


def spans(sentence: str) -> list[dict]:
    """Pattern candidates of a sentence. A name's steps share a match; ``ok`` says whether it holds up
    by itself, ``bare`` whether it needs the dictionary to."""
    out, n = [], 0

    def add(kind: str, method: str, steps: list[tuple[str, int]], ok, bare) -> None:
        nonlocal n
        for k, (text, start) in enumerate(steps):
            end = start + len(text)
            out.append(
                {"match_no": n, "step": k, "last": len(steps) - 1, "entity_text": text, "entity_type": kind, "method": method,
                 "start_pos": start, "end_pos": end, "ok": bool(ok(text, start, end)), "bare": bool(bare(text))}
            )
        n += 1

    def bare_area(text: str) -> bool:
        noise = len(text) <= 4 and text.startswith(tuple(NOISE_STARTS))
        return not noise and not (len(text) == 2 and text.endswith(("市", "区", "旗")))

    for m in NAME_PATTERN.finditer(sentence):
        add("ADMIN_AREA", "regex_admin_area", stripped(m[0], m.start()), lambda t, a, b: _area_ok(t, sentence[b : b + 1]), bare_area)
    for m in OFFICE_PATTERN.finditer(sentence):
        add("GOV_ORG", "regex_government_org", [(m[0].strip(EDGE), m.start())], lambda t, a, b: valid(t), lambda t: True)
    for m in ADDRESS_PATTERN.finditer(sentence):
        text, start = m[0].strip(EDGE), m.start()
        for mark in sorted(RESIDENCE_MARKS, key=len, reverse=True):
            k = text.rfind(mark)
            if k >= 0 and k + len(mark) < len(text):
                text, start = text[k + len(mark) :].strip(EDGE), start + k + len(mark)
                break
        left = sentence[max(0, start - 4) : start]
        placed = any(k in left for k in RESIDENCE_LEFT) or "号" in text
        counted = re.search("[0-9一二三四五六七八九十百千万]+个(?:街道|镇|乡|村)", text)
        fine = placed and "街道办事处" not in text and not counted
        add("ADDRESS", "regex_address", [(text, start)], lambda t, a, b, fine=fine: fine and valid(t), lambda t: True)
    return out


SPAN = "match_no int, step int, last int, entity_text string, entity_type string, method string, start_pos int, end_pos int, ok boolean, bare boolean"


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["sentence_id", *(f.split()[0] for f in SPAN.split(", "))]
    for pdf in batches:
        rows = [{"sentence_id": i} | s for i, text in zip(pdf["sentence_id"], pdf["sentence"], strict=True) for s in spans(text or "")]
        yield pd.DataFrame(rows, columns=columns)


def lexicon(codes: DataFrame) -> DataFrame:
    """One row per name of ``codes`` (code, name: a comma path from the country down), its records folded:
    codes and first five paths in code order, distinct sorted levels and parents, and their number."""
    parts = F.filter(F.transform(F.split("name", ","), lambda p: F.trim(p)), lambda p: (p != "") & (p != "中国"))
    df = codes.select(F.trim("code").alias("code"), parts.alias("p")).where(F.size("p") > 0)
    at = lambda k: F.coalesce(F.try_element_at("p", F.lit(k)), F.lit(""))
    level, name, first = code_level(F.col("code")), at(-1), at(1)
    deep = F.size("p")
    county = F.when(level == "county", name).when((level == "township") & (deep >= 2), at(-2)).otherwise("")
    prefecture = (
        F.when(level == "prefecture", name)
        .when((level == "county") & (deep >= 2), at(-2))
        .when((level == "township") & (deep >= 3), at(-3))
        .when(level.isin("county", "township"), first)
        .otherwise("")
    )
    df = df.select("code", name.alias("name"), level.alias("level"), first.alias("province"), prefecture.alias("prefecture"), county.alias("county"), F.array_join("p", "/").alias("path"))
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), "|")
    ordered = F.array_sort(F.collect_list(F.struct("code", "path")))
    good = ~F.col("name").isin(STOP_NAMES) & (F.char_length("name") >= 2)
    return (
        df.where(good)
        .groupBy("name")
        .agg(
            F.array_join(ordered["code"], "|").alias("admin_code"),
            distinct("level").alias("admin_level"),
            distinct("province").alias("province"),
            distinct("prefecture").alias("prefecture"),
            distinct("county").alias("county"),
            F.array_join(F.slice(ordered["path"], 1, 5), "|").alias("full_path"),
            F.count("*").alias("matches"),
        )
    )


def dictionary_matches(sents: DataFrame, names: DataFrame, text: str = "sentence", keys: list[str] = ["sentence_id"]) -> DataFrame:  # noqa: B006
    """Every place where a name of ``names`` (name) stands in a text: keys, start_pos, end_pos, name.

    Substrings are cut at the lengths that the names have, and only where a text is long enough; the
    lookup is an equi-join, so neither side has to fit anywhere.
    """
    lengths = sorted(r[0] for r in names.select(F.char_length("name").alias("n")).where("n > 0").distinct().collect())
    rows = sents.select(*keys, F.inline(_pieces(text, lengths)))
    found = rows.join(names.select("name").distinct(), "name")
    return found.select(*keys, "start_pos", (F.col("start_pos") + F.char_length("name")).alias("end_pos"), "name")


def _pieces(text: str, lengths: list[int]) -> Column:
    none = F.array().cast("array<struct<start_pos:int,name:string>>")

    def of(size: int) -> Column:
        cut = lambda i: F.struct(i.alias("start_pos"), F.substr(F.col(text), i + 1, F.lit(size)).alias("name"))
        return F.when(F.char_length(text) >= size, F.transform(F.sequence(F.lit(0), F.char_length(text) - size), cut)).otherwise(none)

    return F.concat(none, *map(of, lengths))


def candidates(sents: DataFrame, names: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All entity candidates with the dictionary's columns. ``extra``: more of them from a model, with the
    columns sentence_id, entity_text, entity_type, start_pos, end_pos."""
    exact = dictionary_matches(sents, names).join(sents.select("sentence_id", "sentence"), "sentence_id")
    following = F.substr("sentence", F.col("end_pos") + 1, F.lit(1))
    exact = exact.where(~((following == "级") | ((F.col("name") == "和县") & (following == "的"))))
    bad_name = "|".join(NOT_IN_NAMES)
    exact = exact.where(~F.col("name").rlike(bad_name)).select(
        "sentence_id", F.col("name").alias("entity_text"), F.lit("ADMIN_AREA").alias("entity_type"), F.lit("lexicon_exact").alias("method"), "start_pos", "end_pos"
    )
    exact = exact.join(names.withColumnRenamed("name", "entity_text"), "entity_text")
    found = sents.select("sentence_id", "sentence").mapInPandas(_spans, f"sentence_id string, {SPAN}")
    found = found.join(names.withColumnRenamed("name", "entity_text"), "entity_text", "left")
    known = F.col("matches").isNotNull()
    pick = F.when(known | (F.col("step") == F.col("last")), F.col("step"))
    chosen = F.min(pick).over(Window.partitionBy("sentence_id", "match_no"))
    found = found.withColumn("_k", chosen).where((F.col("step") == F.col("_k")) & F.col("ok") & (F.col("bare") | known | (F.col("entity_type") != "ADMIN_AREA")))
    out = exact.unionByName(found.drop("match_no", "step", "last", "ok", "bare", "_k"))
    if extra is not None:
        more = extra.select("sentence_id", "entity_text", "entity_type", F.lit("paddle_uie").alias("method"), "start_pos", "end_pos")
        out = out.unionByName(more.join(names.withColumnRenamed("name", "entity_text"), "entity_text", "left"))
    confidence, priority = F.lit(None).cast("double"), F.lit(0)
    for method, (rank, plain, listed) in METHODS.items():
        own = F.col("method") == method
        better = (F.col("matches") == 1) if method == "lexicon_exact" else F.col("matches").isNotNull()
        confidence = F.when(own, F.when(better, listed).otherwise(plain)).otherwise(confidence)
        priority = F.when(own, rank).otherwise(priority)
    return out.withColumns({"confidence": confidence, "priority": priority}).where("end_pos > start_pos and start_pos >= 0")


def merged(cands: DataFrame) -> DataFrame:
    """One row per place, type and name: methods joined, the best confidence and priority."""
    info = ["admin_code", "admin_level", "province", "prefecture", "county", "full_path", "matches"]
    return cands.groupBy("sentence_id", "start_pos", "end_pos", "entity_type", "entity_text").agg(
        F.array_join(F.array_sort(F.collect_set("method")), "|").alias("method"),
        F.max("confidence").alias("confidence"),
        F.max("priority").alias("priority"),
        *(F.max(c).alias(c) for c in info),
    )


def greedy(cands: DataFrame, keys: list[str], score: list[str], columns: list[str], start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Per group: from the best score down, each span that overlaps none kept before.

    A fold over the group's sorted array; groups are sentences, so an array is as long as a
    sentence has candidates. Ties go to the earlier, then shorter span, then by the columns' order.
    """
    order = [(-F.col(s)).alias(f"_s{i}") for i, s in enumerate(score)]
    rest = [c for c in columns if c not in (start, end)]
    item = F.struct(*order, start, end, *rest)
    grouped = cands.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    empty = F.slice("_all", 1, 0)
    kept = F.aggregate("_all", empty, lambda acc, x: F.when(F.exists(acc, lambda k: (x[start] < k[end]) & (k[start] < x[end])), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(*keys, F.inline(kept)).select(*keys, start, end, *rest)


def extract(sents: DataFrame, codes: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Entities of ``sents`` (sentence_id, sentence), in disjoint spans, with the dictionary's columns.

    Null sentences have none; an empty dictionary leaves the patterns."""
    names = lexicon(codes)
    all_ = merged(candidates(sents.withColumn("sentence", F.coalesce("sentence", F.lit(""))), names, extra))
    all_ = all_.withColumn("_length", F.col("end_pos") - F.col("start_pos"))
    columns = ["start_pos", "end_pos", "entity_text", "entity_type", "method", "confidence", "admin_code", "admin_level", "province", "prefecture", "county", "full_path", "matches"]
    out = greedy(all_, ["sentence_id"], ["priority", "_length", "confidence"], columns)
    text = ["admin_code", "admin_level", "province", "prefecture", "county", "full_path"]
    return out.na.fill("", text).withColumns(
        {
            "normalized_name": F.col("entity_text"),
            "is_from_code_table": F.col("matches").isNotNull().cast("int"),
            "is_ambiguous": F.coalesce((F.col("matches") > 1).cast("int"), F.lit(0)),
            "is_uie_enhanced": F.col("method").contains("paddle_uie").cast("int"),
        }
    ).drop("matches")


def numbered(entities: DataFrame) -> DataFrame:
    """With entity_id E000001 ... by sentence, place and text."""
    return dense_ids(entities, ["sentence_id", "start_pos", "end_pos", "entity_text"], "entity_id", "E%06d")


def sentence_entities(sents: DataFrame, entities: DataFrame) -> DataFrame:
    """Every sentence with counts of its entities by type and their texts in order."""
    is_ = lambda t: F.count_if(F.col("entity_type") == t)
    per = entities.groupBy("sentence_id").agg(
        F.count("*").alias("entity_count"),
        is_("ADMIN_AREA").alias("admin_area_count"),
        is_("GOV_ORG").alias("gov_org_count"),
        is_("ADDRESS").alias("address_count"),
        F.count_if(F.col("admin_code") != "").alias("coded_admin_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "entity_text"))), lambda x: x["entity_text"]), " / ").alias("entities"),
    )
    counts = ["entity_count", "admin_area_count", "gov_org_count", "address_count", "coded_admin_count"]
    return sents.join(per, "sentence_id", "left").na.fill(0, counts).na.fill("", ["entities"])


def without_entities(sents: DataFrame, entities: DataFrame) -> DataFrame:
    return sents.join(entities.select("sentence_id"), "sentence_id", "left_anti")


def entity_frequency(entities: DataFrame, order: list[str]) -> DataFrame:
    """Per type and name: count, sentences, years, methods, codes, levels and the first example."""
    pieces = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(c, r"\|"), lambda x: x != ""))))), "|")
    whole = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), "|")
    return entities.groupBy("entity_type", "normalized_name").agg(
        F.count("*").alias("count"),
        F.countDistinct("sentence_id").alias("sentence_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        pieces("method").alias("methods"),
        whole("admin_code").alias("admin_codes"),
        whole("admin_level").alias("admin_levels"),
        F.min_by("sentence", F.struct(*order)).alias("example_sentence"),
    )


def method_summary(entities: DataFrame) -> DataFrame:
    rows = entities.withColumn("method", F.explode(F.split("method", r"\|")))
    return rows.groupBy("entity_type", "method").agg(
        F.count("*").alias("entity_count"), F.countDistinct("normalized_name").alias("unique_entity_count"), F.bround(F.avg(F.col("confidence").cast("decimal(9,4)")), 4).cast("double").alias("avg_confidence")
    )


def unmatched_areas(entities: DataFrame, order: list[str]) -> DataFrame:
    """Frequencies of the names that the dictionary doesn't have."""
    return entity_frequency(entities.where("entity_type = 'ADMIN_AREA' and coalesce(admin_code, '') = ''"), order)


def entity_overview(sents: DataFrame, entities: DataFrame) -> DataFrame:
    e = entities.agg(
        F.count("*").alias("entity_count"),
        F.countDistinct("normalized_name").alias("unique_entity_count"),
        F.countDistinct("sentence_id").alias("sentence_with_entity_count"),
        *(F.count_if(F.col("entity_type") == t).alias(f"{t.lower()}_count") for t in ("ADMIN_AREA", "GOV_ORG", "ADDRESS")),
        F.count_if(F.col("admin_code") != "").alias("coded_entity_count"),
        F.count_if(F.col("is_ambiguous") == 1).alias("ambiguous_entity_count"),
    )
    # two rows of totals side by side
    s = sents.agg(F.count("*").alias("sentence_count"))
    return s.withColumn("_one", F.lit(1)).join(e.withColumn("_one", F.lit(1)), "_one").drop("_one")
