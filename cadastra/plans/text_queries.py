"""Notice and token operators on the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.text import split_sentences
from cadastra.operators import notices, tokens
from cadastra.operators.stages import settle
from cadastra.sources.tables import load

ENDS = ".!?;"
HEADER = r"^(The|Of|In|A|An|That) (.+)$"
TITLE, NOTE = "All rights reserved", "Licensed under"
CUES = {"with": "with", "action": "ing|ed", "noun": "tion", "was": "was|were", "article": "the"}
TOKEN = r"[^\s.,!?;:|]+|[.,!?;:|]"
VERB_END = r"(?:ing|ed)(?![^\s.,!?;:|])"
KEYS = ["doc_id", "line_no", "sentence_no"]


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: the year is made up from the id, lines are split at newlines."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "raw_line"))
    return docs.select(F.col("doc_id").alias("source_file"), (1999 + F.col("doc_id") % 28).cast("int").alias("year"), (F.col("i") + 1).alias("line_no"), "raw_line")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.parse_lines(source_lines(spark, sf_dir), HEADER, TITLE, NOTE, ENDS)


def tag(t: Column) -> Column:
    """Marks, verbs, capitals and the rest; a pattern is tried only where an ending fits."""
    verb = (t.endswith("ing") | t.endswith("ed")) & t.rlike("^[a-z]+(ing|ed)$")
    return F.when(t.isin(list(".,!?;:|")), "w").when(verb, "v").when(F.left(t, F.lit(1)).between("A", "Z"), "LOC").otherwise("n")


def tagging(spark: SparkSession, sf_dir: str, verbs: int = 0) -> DataFrame:
    """Sentences with their tokens and tags, for one reader that filters nothing by them; only those with
    at least so many tokens that end like a verb."""
    sents = notices.sentences(parsed(spark, sf_dir)).withColumnRenamed("source_file", "doc_id")
    if verbs:
        some = F.col("sentence").contains("ing") | F.col("sentence").contains("ed")
        sents = sents.where(some & F.col("sentence").rlike(".*".join([VERB_END] * verbs)))
    got = tokens.tag_sentences(sents, F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)), tag)
    return got.select(*KEYS, "year", "sentence", "tokens", "tags")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tagging``, made once: a filter on them would make them again."""
    return settle(tagging(spark, sf_dir))


def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select(
        "source_file", "year", "line_no", "item_no", "parsed_text", "is_skipped", "skip_reason", F.size("sentences").alias("sentence_count")
    )


def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices.sentences(parsed(spark, sf_dir))
    return notices.dense_ids(rows, ["source_file", "line_no", "sentence_no"], "sentence_id", "S%08d").select(
        "sentence_id", "source_file", "line_no", "item_no", "sentence"
    )


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = settle(parsed(spark, sf_dir).select("source_file", "year", "line_no", "item_no", "is_skipped", "sentences"))
    caps = notices.sentences(lines).where(F.col("sentence").rlike("with")).select("source_file", "line_no", "sentence_no")
    return notices.file_coverage(lines, caps)


def q_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sents = docs.select("source", F.explode(split_sentences(F.col("text"), ENDS)).alias("sentence"))
    found = notices.sentence_patterns(sents, cues=CUES)
    return notices.pattern_summary(found, ["source"], F.col("sentence_length"), "avg_sentence_length", CUES)


def q_primary_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.sentence_patterns(notices.sentences(parsed(spark, sf_dir)), cues=CUES)
    return found.groupBy("primary_cue", "cue_labels").agg(F.count("*").alias("sentence_count"), F.sum("sentence_length").alias("chars"))


def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_context(tagging(spark, sf_dir), keep=KEYS)


def q_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sentence_stats(tagged(spark, sf_dir), KEYS)


def q_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.verb_frequency(tokens.verb_rows(tagging(spark, sf_dir), ["year"]), min_count=2)


def q_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_frames(tokens.verb_rows(tagging(spark, sf_dir), ["year"]))


def q_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.verb_cooccurrence(tagging(spark, sf_dir, verbs=2), KEYS, "sentence")  # a sentence with fewer has no pair


def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = tagging(spark, sf_dir)
    rows = settle(tokens.verb_rows(sents, [*KEYS, "year"]))
    return tokens.relation_candidates(tokens.verb_frequency(rows, min_count=3), tokens.context_frames(rows), tokens.examples(rows, sents, KEYS, "sentence", 3))


def q_token_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_overview(tagged(spark, sf_dir), "doc_id")


_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_SPLIT = rf"list_filter(list_transform(string_split(regexp_replace({_CLEAN}, '([{ENDS}])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_LINES = rf"""
raw AS (SELECT doc_id AS source_file, CAST(1999 + doc_id % 28 AS INTEGER) AS year, unnest(string_split(text, chr(10))) AS raw_line,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
lines AS (SELECT *, {_CLEAN.format('raw_line')} AS line FROM raw),
marked AS (SELECT *, CASE WHEN line = '' THEN 'empty' WHEN contains(line, '{TITLE}') THEN 'title' WHEN starts_with(line, '{NOTE}') THEN 'sequence_note' ELSE '' END AS skip_reason FROM lines),
headed AS (SELECT *, CASE WHEN skip_reason = '' AND regexp_matches(line, '{HEADER}') THEN regexp_extract(line, '{HEADER}', 1) END AS head FROM marked),
bodied AS (SELECT *, CASE WHEN head IS NOT NULL THEN trim(regexp_extract(line, '{HEADER}', 2)) ELSE line END AS body,
  coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS item_no FROM headed),
parsed AS (SELECT source_file, year, CAST(line_no AS INTEGER) AS line_no, item_no, CASE WHEN skip_reason = '' THEN body ELSE '' END AS parsed_text,
  CAST(skip_reason <> '' AS INTEGER) AS is_skipped, skip_reason, CASE WHEN skip_reason = '' THEN {_SPLIT.format('body')} ELSE [] END AS sents FROM bodied),
sent AS (SELECT source_file, year, line_no, item_no, CAST(unnest(range(len(sents))) AS INTEGER) AS sentence_no, unnest(sents) AS sentence FROM parsed)
"""
_FLAGS = ", ".join(f"CAST(regexp_matches(sentence, '{p}') AS INTEGER) AS has_{k}" for k, p in CUES.items())
_TOKENS = rf"""{_LINES},
tk AS (SELECT source_file AS doc_id, year, line_no, sentence_no, sentence, regexp_extract_all(sentence, '{TOKEN}') AS ts FROM sent),
tok AS (SELECT doc_id, year, line_no, sentence_no, sentence, len(ts) AS n, unnest(ts) AS token, CAST(unnest(range(1, len(ts) + 1)) AS INTEGER) AS token_index FROM tk),
pos AS (SELECT *, CASE WHEN regexp_matches(token, '^[.,!?;:|]$') THEN 'w' WHEN regexp_matches(token, '^[a-z]+(ing|ed)$') THEN 'v'
  WHEN regexp_matches(token, '^[A-Z]') THEN 'LOC' ELSE 'n' END AS pos FROM tok),
ctx AS (SELECT doc_id, year, line_no, sentence_no, sentence, token_index, token, pos, CAST(pos = 'v' AS INTEGER) AS is_verb, CAST(pos = 'LOC' AS INTEGER) AS is_location,
  CAST(round_even(CAST(CAST((token_index / n) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS token_position_ratio,
  coalesce(lag(token) OVER w, '') AS prev_token, coalesce(lag(pos) OVER w, '') AS prev_pos,
  coalesce(lead(token) OVER w, '') AS next_token, coalesce(lead(pos) OVER w, '') AS next_pos,
  CAST(token_index = 1 AS INTEGER) AS is_sentence_initial, CAST(coalesce(lag(pos) OVER w, '') = 'w' AS INTEGER) AS is_after_punctuation,
  max(CAST(pos = 'LOC' AS INTEGER)) OVER (PARTITION BY doc_id, line_no, sentence_no ORDER BY token_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near_location
  FROM pos WINDOW w AS (PARTITION BY doc_id, line_no, sentence_no ORDER BY token_index))
"""
_FREQ = """
fr0 AS (SELECT token AS verb, count(*) AS count, count(DISTINCT (doc_id, line_no, sentence_no)) AS sentence_count, min(year) AS first_year, max(year) AS last_year,
  'v' AS pos_tags, CAST(round_even(CAST(CAST((avg(is_sentence_initial)) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS initial_rate, CAST(round_even(CAST(CAST((avg(is_after_punctuation)) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS after_punctuation_rate,
  CAST(round_even(CAST(CAST((avg(near_location)) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS near_location_rate, CAST(round_even(CAST(CAST((CAST(sum(CAST(token_position_ratio AS DECIMAL(9, 6))) AS DOUBLE) / count(*)) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS avg_position_ratio FROM ctx WHERE is_verb = 1 GROUP BY token),
fr1 AS (SELECT *, CAST(round_even(CAST(CAST((count / sum(count) OVER ()) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS frequency_ratio FROM fr0),
freq AS (SELECT *, CAST(row_number() OVER o AS INTEGER) AS rank, CAST(sum(count) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_count,
  CAST(round_even(CAST(CAST((sum(count) OVER (o ROWS UNBOUNDED PRECEDING) / sum(count) OVER ()) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS cumulative_ratio
  FROM fr1 WHERE count >= {n} WINDOW o AS (ORDER BY count DESC, verb))
"""
_FRAMES = """
frames AS (SELECT token AS verb, prev_pos || ':' || prev_token || ' <- ' || token || ' -> ' || next_pos || ':' || next_token AS frame, count(*) AS count,
  count(DISTINCT (doc_id, line_no, sentence_no)) AS sentence_count, min(year) AS first_year, max(year) AS last_year, CAST(round_even(CAST(CAST((avg(near_location)) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS near_location_rate
  FROM ctx WHERE is_verb = 1 GROUP BY ALL)
"""

QUERIES = {
    "notice_lines": q_lines,
    "notice_sentences": q_sentences,
    "file_coverage": q_coverage,
    "cue_summary_by_source": q_cues,
    "primary_cues": q_primary_cue,
    "token_context": q_context,
    "sentence_stats": q_sentence_stats,
    "verb_frequency": q_verbs,
    "context_frames": q_frames,
    "verb_cooccurrence": q_cooccurrence,
    "relation_candidates": q_candidates,
    "token_overview": q_token_overview,
}
ORACLES = {
    "notice_lines": f"WITH {_LINES} SELECT source_file, year, line_no, item_no, parsed_text, is_skipped, skip_reason, CAST(len(sents) AS INTEGER) AS sentence_count FROM parsed",
    "notice_sentences": f"WITH {_LINES} SELECT printf('S%08d', row_number() OVER (ORDER BY source_file, line_no, sentence_no)) AS sentence_id, source_file, line_no, item_no, sentence FROM sent",
    "file_coverage": f"""WITH {_LINES},
l AS (SELECT source_file, year, count(*) AS source_line_count, sum(is_skipped)::BIGINT AS skipped_line_count, sum(1 - is_skipped)::BIGINT AS parsed_line_count, sum(len(sents))::BIGINT AS sentence_count FROM parsed GROUP BY 1, 2),
e AS (SELECT source_file, count(*) AS entity_count, count(DISTINCT (line_no, sentence_no)) AS sentence_with_entity_count FROM sent WHERE regexp_matches(sentence, 'with') GROUP BY 1)
SELECT l.*, coalesce(entity_count, 0) AS entity_count, coalesce(sentence_with_entity_count, 0) AS sentence_with_entity_count,
  sentence_count - coalesce(sentence_with_entity_count, 0) AS zero_entity_sentence_count,
  CAST(round_even(CAST(CAST((CASE WHEN sentence_count = 0 THEN 0.0 ELSE coalesce(sentence_with_entity_count, 0) / sentence_count END) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS sentence_entity_coverage_ratio
FROM l LEFT JOIN e USING (source_file)""",
    "cue_summary_by_source": f"""WITH s AS (SELECT source, unnest({_SPLIT.format('text')}) AS sentence FROM documents), f AS (SELECT *, length(sentence) AS n, {_FLAGS} FROM s)
SELECT source, count(*) AS sentence_count, CAST(round_even(CAST(CAST((avg(n)) AS VARCHAR) AS DECIMAL(30, 14)), 4) AS DOUBLE) AS avg_sentence_length, {', '.join(f'sum(has_{k})::BIGINT AS {k}_sentence_count' for k in CUES)} FROM f GROUP BY source""",
    "primary_cues": f"""WITH {_LINES}, f AS (SELECT length(sentence) AS n, list_filter([{', '.join(f"CASE WHEN regexp_matches(sentence, '{p}') THEN '{k}' END" for k, p in CUES.items())}], lambda x: x IS NOT NULL) AS c FROM sent)
SELECT coalesce(c[1], 'other') AS primary_cue, array_to_string(c, '|') AS cue_labels, count(*) AS sentence_count, sum(n)::BIGINT AS chars FROM f GROUP BY 1, 2""",
    "token_context": f"WITH {_TOKENS} SELECT doc_id, line_no, sentence_no, {', '.join(tokens.CONTEXT)} FROM ctx",
    "sentence_stats": f"""WITH {_TOKENS}, h AS (SELECT doc_id, line_no, sentence_no, pos, count(*) AS n FROM ctx GROUP BY ALL),
hh AS (SELECT doc_id, line_no, sentence_no, string_agg(pos || ':' || n, ';' ORDER BY pos) AS pos_counts FROM h GROUP BY 1, 2, 3)
SELECT doc_id, line_no, sentence_no, count(*) AS token_count, sum(is_verb)::BIGINT AS verb_count, sum(is_location)::BIGINT AS location_count,
  coalesce(string_agg(token, ' / ' ORDER BY token_index) FILTER (is_verb = 1), '') AS verbs, any_value(pos_counts) AS pos_counts FROM ctx JOIN hh USING (doc_id, line_no, sentence_no) GROUP BY 1, 2, 3""",
    "verb_frequency": f"WITH {_TOKENS}, {_FREQ.format(n=2)} SELECT * FROM freq",
    "context_frames": f"WITH {_TOKENS}, {_FRAMES} SELECT * FROM frames",
    "verb_cooccurrence": f"""WITH {_TOKENS}, v AS (SELECT doc_id, line_no, sentence_no, sentence, token AS verb, count(*) AS tf FROM ctx WHERE is_verb = 1 GROUP BY ALL)
SELECT a.verb AS verb_a, b.verb AS verb_b, sum(a.tf + b.tf)::BIGINT AS cooccurrence_score, count(*) AS sentence_count, arg_min(a.sentence, (a.doc_id, a.line_no, a.sentence_no)) AS example_sentence
FROM v a JOIN v b USING (doc_id, line_no, sentence_no) WHERE a.verb < b.verb GROUP BY 1, 2""",
    "relation_candidates": f"""WITH {_TOKENS}, {_FREQ.format(n=3)}, {_FRAMES},
rf AS (SELECT verb, string_agg(frame, ' || ' ORDER BY count DESC, frame) AS representative_frames FROM (SELECT *, row_number() OVER (PARTITION BY verb ORDER BY count DESC, frame) AS k FROM frames) WHERE k <= 5 GROUP BY verb),
ex AS (SELECT verb, string_agg(sentence, ' || ' ORDER BY doc_id, line_no, sentence_no) AS example_sentences FROM (
  SELECT *, row_number() OVER (PARTITION BY verb ORDER BY doc_id, line_no, sentence_no) AS k FROM (SELECT DISTINCT token AS verb, doc_id, line_no, sentence_no, sentence FROM ctx WHERE is_verb = 1)) WHERE k <= 3 GROUP BY verb)
SELECT verb AS candidate_relation, CAST(round_even(CAST(CAST((ln(1 + count) / ln(1 + max(count) OVER ()) * (0.45 * near_location_rate + 0.25 * after_punctuation_rate + 0.20 * initial_rate + 0.10 * (1 - avg_position_ratio))) AS VARCHAR) AS DECIMAL(30, 14)), 6) AS DOUBLE) AS relation_score,
  count, frequency_ratio, sentence_count, first_year, last_year, near_location_rate, initial_rate, after_punctuation_rate, representative_frames, example_sentences
FROM freq LEFT JOIN rf USING (verb) LEFT JOIN ex USING (verb)""",
    "token_overview": f"""WITH {_TOKENS} SELECT count(DISTINCT doc_id) AS source_count, count(DISTINCT (doc_id, line_no, sentence_no)) AS sentence_count, count(*) AS token_count, sum(is_verb)::BIGINT AS verb_count,
  count(DISTINCT token) FILTER (is_verb = 1) AS distinct_verb_count, sum(is_location)::BIGINT AS location_count FROM ctx""",
}
