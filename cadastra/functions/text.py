"""Text expressions: cleaning, sentences, headers, cue patterns, ordered labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence ends after one of these.
SENTENCE_ENDS = "。！？；;"
#: An item header is one or more of these numerals and an enumeration comma.
ITEM_HEADER = r"^([一二三四五六七八九十百〇零两]+)、(.+)$"
#: What a change notice's sentence says, by label in order of precedence.
CHANGE_CUES = {
    "revoke": "撤销",
    "establish": "设立|设置|增设",
    "rename": "更名",
    "transfer": "划归|划入|划出",
    "govern": "管辖|辖|直辖|代管",
    "residence": "人民政府驻|政府驻|驻地|迁至|迁移",
    "adjustment": "行政区划调整|调整",
}
LIST_SEPARATOR = " / "


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_line(x: Column) -> Column:
    """Trimmed, with runs of white space as one blank; Unicode spaces count."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_cell(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def split_sentences(x: Column, ends: str = SENTENCE_ENDS, cleaned: bool = False) -> Column:
    """Array of the sentences of a text, each with its end mark. A text that ``clean_line`` has been through isn't cleaned again."""
    line = F.coalesce(x, F.lit(""))
    parts = F.regexp_extract_all(line if cleaned else clean_line(line), F.lit(f"[^{ends}]+[{ends}]?|[{ends}]"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def year_of_file(name: Column) -> Column:
    """Year that a file name such as 2001_changes.txt begins with, else null."""
    return F.nullif(F.regexp_extract(name, r"^(\d{4})_", 1), F.lit("")).cast("int")


def cue_labels(sentence: Column, cues: dict[str, str]) -> Column:
    """Array of the labels whose pattern is found, in the order of ``cues``."""
    found = F.array(*(F.when(sentence.rlike(p), F.lit(label)) for label, p in cues.items()))
    return F.array_compact(found)


def canonical(labels: Column, order: list[str], fallback: str | None = None) -> Column:
    """Known labels without repeats in canonical order; the fallback where none is known."""
    known = F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(labels, x))
    if fallback is None:
        return known
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(fallback)))


def split_list(x: Column, separator: str = LIST_SEPARATOR) -> Column:
    """Items of a delimited string, trimmed, without blanks."""
    parts = F.split(F.coalesce(x, F.lit("")), F.lit("\\Q" + separator.strip() + "\\E"))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def join_distinct(items: Column, separator: str = LIST_SEPARATOR) -> Column:
    """Items in order of first appearance, without blanks, as one string."""
    return F.array_join(F.array_distinct(F.filter(items, lambda s: F.trim(F.coalesce(s, F.lit(""))) != "")), separator)


def admin_code(x: Column, width: int = 6) -> Column:
    """Code as text with leading zeros: '1100.0' becomes 001100; longer codes stay whole."""
    number = x.cast("string").try_cast("double")
    plain = F.coalesce(number.cast("bigint").cast("string"), F.trim(x.cast("string")))
    return F.when(F.length(plain) < width, F.lpad(plain, width, "0")).otherwise(plain)


def code_level(code: Column) -> Column:
    return (
        F.when(F.length(code) >= 9, "township").when(code.endswith("0000"), "province").when(code.endswith("00"), "prefecture").otherwise("county")
    )


def stable_id(text: Column, prefix: str = "ENT_") -> Column:
    """Content-addressed id: prefix and the first 16 hex digits of the MD5."""
    return F.concat(F.lit(prefix), F.substring(F.md5(text.cast("binary")), 1, 16))
