"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece
encoding. Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, whatever else a caller's table carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import DOCUMENT_COLUMNS, cut, cut_alone, forget, pick, sent_if_few, table
from cadastra.llm.decontaminate import decontaminate
from cadastra.llm.line_dedup import line_dedup
from cadastra.llm.near_copies import without_copies
from cadastra.llm.piece_codec import encode_decode, model_path
from cadastra.llm.quality import with_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: a score of 0.5 or more. Null and empty texts
    are scored like any other, rows that repeat alike; without labels all stay."""
    scored = with_quality(pick(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("score >= 0.5").select(*DOCUMENT_COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines. A null text stays null; rows that repeat a doc_id
    and a text lose the same lines."""
    return line_dedup(pick(docs, *DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document: the smallest doc_id, null last, then any one text.
    Near copies are linked by every pair whose five-word shingles have a Jaccard similarity of
    0.8 or more; unlike texts that share a doc_id all stay. Null and wordless texts are one group."""
    return without_copies(pick(docs, *DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word in a benchmark window, however long they are.

    Rows are judged by doc_id and text together, so a clean text stays whatever else has its
    doc_id, and a null doc_id is a value of its own. Wordless texts stay, repeated rows repeat."""
    docs = pick(docs, *DOCUMENT_COLUMNS)
    got = decontaminate(docs, table(spark, sf_dir, "benchmark"), row_hash=True)
    same = F.xxhash64("doc_id", "text")
    bad = cut(got.where("n_hit > 0").select("row_hash").distinct(), "contaminated")
    return docs.withColumn("row_hash", same).join(sent_if_few(bad), "row_hash", "left_anti").select(*DOCUMENT_COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count and the digests of a round trip. A null text
    counts as empty; every row gives a row."""
    return encode_decode(docs, model_path(), ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encode_stage),
]

#: Trained scores, fingerprints and merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables that the others wrote on their way are deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut_alone(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
