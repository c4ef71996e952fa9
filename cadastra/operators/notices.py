"""Change notices: lines, items and sentences of source files, their cues and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.text import CHANGE_CUES, ITEM_HEADER, SENTENCE_ENDS, clean_line, cue_labels, split_sentences
from cadastra.operators.stages import settle

#: Lines that hold no notice.
TITLE_MARK = "县级以上行政区划变更情况"
NOTE_START = "（以行政区划变更公布时间为序"


def parse_lines(
    source_lines: DataFrame, header: str = ITEM_HEADER, title: str = TITLE_MARK, note: str = NOTE_START, ends: str = SENTENCE_ENDS
) -> DataFrame:
    """Audit of every line of ``source_lines`` (source_file, year, line_no, raw_line).

    Adds item_no (carried forward in its file from the last header, '' before the first),
    parsed_text, is_skipped, skip_reason (empty, title, sequence_note or '') and ``sentences``
    (array). The only shuffle is by source_file, for the carry-forward.
    """
    line = clean_line(F.coalesce("raw_line", F.lit("")))
    reason = F.when(line == "", "empty").when(line.contains(title), "title").when(line.startswith(note), "sequence_note").otherwise("")
    df = source_lines.select("source_file", "year", "line_no", "raw_line", line.alias("line"), reason.alias("skip_reason"))
    head = (F.col("skip_reason") == "") & F.col("line").rlike(header)
    df = df.withColumn("_head", F.when(head, F.regexp_extract("line", header, 1)))
    body = F.when(F.col("_head").isNotNull(), F.trim(F.regexp_extract("line", header, 2))).otherwise(F.col("line"))
    so_far = Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "source_file",
        "year",
        "line_no",
        F.coalesce(F.last("_head", ignorenulls=True).over(so_far), F.lit("")).alias("item_no"),
        "raw_line",
        F.when(F.col("skip_reason") == "", body).otherwise("").alias("parsed_text"),
        (F.col("skip_reason") != "").cast("int").alias("is_skipped"),
        "skip_reason",
        F.when(F.col("skip_reason") == "", split_sentences(body, ends, cleaned=True)).otherwise(F.array().cast("array<string>")).alias("sentences"),
    )


def sentences(parsed: DataFrame, limit: int = 0) -> DataFrame:
    """One row per sentence with a position (sentence_no) inside its line, in file order.

    Lines without sentences are left out afterwards: Spark guards a plain posexplode by a filter on the
    array's size, which cleans and splits every line again, several times over.
    """
    rows = parsed.select("source_file", "year", "line_no", "item_no", F.posexplode_outer("sentences").alias("sentence_no", "sentence"))
    rows = rows.where(F.col("sentence_no").isNotNull())
    return rows.orderBy("source_file", "line_no", "sentence_no").limit(limit) if limit > 0 else rows


def running(df: DataFrame, order: list, value: str | None, rank: str, total: str = "") -> DataFrame:
    """Rank in a total order (long, from 1) and the running sum of ``value``, without a task that sees all rows.

    Rows are dealt to ranges of the order and settled, so that a range keeps its rows; the ranges'
    counts and sums, one row each, are summed up in order, and rows are numbered inside their range.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_p").agg(F.count("*").alias("_n"), *([F.sum(value).alias("_t")] if value else []))
    starts = sums.select("_p", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in sums.columns[1:]))
    inside = Window.partitionBy("_p").orderBy(*order)
    out = ranged.withColumn("_k", F.row_number().over(inside))
    if value:
        out = out.withColumn("_s", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(starts), "_p").withColumn(rank, F.col("_n_start") + F.col("_k"))  # a row per range
    if value:
        out = out.withColumn(total, F.col("_t_start") + F.col("_s"))
    return out.drop("_p", "_k", "_s", "_n_start", "_t_start")


def dense_ids(df: DataFrame, order: list[str], name: str, template: str) -> DataFrame:
    """Ids such as S000001 in a total order."""
    return running(df, order, None, "_r").withColumn(name, F.format_string(template, "_r")).drop("_r")


def sentence_patterns(sents: DataFrame, entity_counts: DataFrame | None = None, cues: dict[str, str] = CHANGE_CUES, text: str = "sentence") -> DataFrame:
    """Cue flags (has_*), labels joined by ``|``, the first label as primary (or other), and the
    number of entities if ``entity_counts`` (sentence_id, entity_count) is given."""
    df = sents.withColumn("_cues", cue_labels(F.col(text), cues))
    df = df.withColumns(
        {
            "sentence_length": F.char_length(text),
            "cue_labels": F.array_join("_cues", "|"),
            "primary_cue": F.coalesce(F.try_element_at("_cues", F.lit(1)), F.lit("other")),
            **{f"has_{c}": F.array_contains("_cues", c).cast("int") for c in cues},
        }
    ).drop("_cues")
    if entity_counts is None:
        return df
    return df.join(entity_counts, "sentence_id", "left").withColumn("entity_count", F.coalesce("entity_count", F.lit(0)))


def pattern_summary(patterns: DataFrame, keys: list[str], measure: Column, measure_name: str, cues: dict[str, str] = CHANGE_CUES) -> DataFrame:
    """Per key: sentences, mean of ``measure`` (4 places) and sentences with each cue."""
    return patterns.groupBy(*keys).agg(
        F.count("*").alias("sentence_count"),
        F.bround(F.avg(measure), 4).alias(measure_name),
        *(F.sum(f"has_{c}").alias(f"{c}_sentence_count") for c in cues),
    )


def file_coverage(parsed: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Lines, skipped lines, sentences and sentences with entities of every source file.

    ``entities`` needs source_file, line_no and sentence_no of each entity's sentence.
    """
    lines = parsed.groupBy("source_file", "year").agg(
        F.count("*").alias("source_line_count"),
        F.sum("is_skipped").alias("skipped_line_count"),
        F.sum(1 - F.col("is_skipped")).alias("parsed_line_count"),
        F.sum(F.size("sentences")).alias("sentence_count"),
    )
    if entities is None:
        return lines
    found = entities.groupBy("source_file").agg(
        F.count("*").alias("entity_count"), F.countDistinct("line_no", "sentence_no").alias("sentence_with_entity_count")
    )
    joined = lines.join(found, "source_file", "left").na.fill(0, ["entity_count", "sentence_with_entity_count"])
    share = F.coalesce(F.try_divide("sentence_with_entity_count", "sentence_count"), F.lit(0.0))
    return joined.withColumns(
        {
            "zero_entity_sentence_count": F.col("sentence_count") - F.col("sentence_with_entity_count"),
            "sentence_entity_coverage_ratio": F.bround(share, 6),
        }
    )
