"""Removal of boilerplate lines by their spread over sites.

Each line's hash collects its sites in a HyperLogLog sketch; sketches merge in the shuffle's
partial aggregation, so a line that is everywhere is no larger than another. Lines whose
estimate is near the threshold are counted exactly. A line that is on enough sites is
boilerplate: its first place in the corpus stays, all others go.

Texts are read twice and never shuffled while boilerplate lines are few enough to be sent to all
tasks; beyond ``BROADCAST_LINES`` the places of lines to remove are joined to their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import cut, forget, in_arrow, pick, table, trim

MIN_SITES = 10
#: Shorter lines (after clean-up) are never boilerplate.
MIN_CHARS = 20
#: 2 ** LG_K sketch cells: a standard error of 3.3 % beyond the sparse, near exact range.
LG_K = 10
#: Estimates within this share of the threshold are counted exactly: six standard errors.
NEAR = 0.2
#: Up to this many boilerplate lines (28 bytes each) go to all tasks.
BROADCAST_LINES = 200_000
ROWS = 256

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\r\f\x0b" else c for c in range(256))
_BLANKS = re.compile(rb"  +")
_INSIDE = bytes(range(0x80, 0xC0))  # of UTF-8 characters, all but the first byte


def line_keys(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(line number from 0, 128-bit hash) of a text's lines of ``min_chars`` characters or more, with
    white space joined and trimmed and A-Z lower-cased."""
    from xxhash import xxh3_128_digest

    plain = text.translate(_PLAIN)
    if b"  " in plain:
        plain = _BLANKS.sub(b" ", plain)
    for i, line in enumerate(plain.split(b"\n")):
        if len(line) >= min_chars:
            line = line.strip(b" ")
            if len(line if line.isascii() else line.translate(None, _INSIDE)) >= min_chars:
                yield i, xxh3_128_digest(line)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    column = column.cast(pa.binary())
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).to_pylist()


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                rows, places, keys = [], [], []
                for k, text in enumerate(_texts(b.column("text"))):
                    if text:
                        before = len(keys)
                        for i, key in line_keys(text, min_chars):
                            places.append(i)
                            keys.append(key)
                        rows += [k] * (len(keys) - before)
                pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                own = b.select(["doc_id", "r1", "r2", "site"]).take(pa.array(rows, pa.int64()))
                yield pa.record_batch([*own.columns, pa.array(places, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["doc_id", "r1", "r2", "site", "pos", "k1", "k2"])

    return run


def _row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(7), "text").alias("r2")]


def boilerplate(lines: DataFrame, min_sites: int, near: float = NEAR) -> DataFrame:
    """(k1, k2, first) of the lines on ``min_sites`` sites or more; lines: k1, k2, site, place."""
    per_line = lines.groupBy("k1", "k2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min("place").alias("first"), F.count("*").alias("n")
    )
    per_line = cut(per_line.where((F.col("sites") >= min_sites * (1 - near)) & (F.col("n") >= min_sites)), "lines")
    sure = per_line.where(F.col("sites") > min_sites * (1 + near)).select("k1", "k2", "first")
    unsure = per_line.where(F.col("sites") <= min_sites * (1 + near)).select("k1", "k2", "first")
    exact = lines.join(unsure.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct()
    exact = exact.groupBy("k1", "k2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).join(unsure, ["k1", "k2"])
    out = cut(sure.unionByName(exact.select("k1", "k2", "first")), "boilerplate")
    forget(per_line)
    return out


def _rewriter(bad: pa.Table, min_chars: int):
    """A column function from (doc_id, text) to (text, n_lines, n_removed), without the lines of ``bad``
    but for their first places."""
    pair = np.stack([bad.column("k1").to_numpy(), bad.column("k2").to_numpy()], axis=1).astype("<i8")
    first = bad.column("first").to_pylist()
    made: list[dict] = []

    @F.arrow_udf("struct<text:string,n_lines:int,n_removed:int>")
    def rewrite(ids: pa.Array, texts: pa.Array) -> pa.Array:
        if not made:
            made.append({k.tobytes(): (f["doc_id"], f["pos"]) for k, f in zip(pair, first, strict=True)})
        known, out, counts, removed = made[0], [], [], []
        for doc_id, text in zip(ids.to_pylist(), _texts(texts), strict=True):
            gone = set()
            if text and known:
                gone = {i for i, key in line_keys(text, min_chars) if key in known and known[key] != (doc_id, i)}
            counts.append(0 if text is None else text.count(b"\n") + 1)
            removed.append(len(gone))
            out.append(b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in gone]) if gone else text)
        trim()
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], ["text", "n_lines", "n_removed"])

    return rewrite


def _joined(docs: DataFrame, lines: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` with ``__line_new`` as ``_rewriter`` makes it, by a join of documents and places."""
    gone = lines.join(bad, ["k1", "k2"]).where("place != first").groupBy("r1", "r2").agg(F.collect_set("pos").alias("__line_gone"))
    gone = cut(gone.withColumnsRenamed({"r1": "__line_r1", "r2": "__line_r2"}), "gone")
    r1, r2 = _row_key()
    out = docs.select("*", r1.alias("__line_r1"), r2.alias("__line_r2")).join(gone, ["__line_r1", "__line_r2"], "left")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__line_gone"))
    kept = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.element_at(p, i + 1)), "\n")), 1)
    new = F.struct(
        F.when(F.col("__line_gone").isNotNull(), kept).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(F.col("__line_gone").isNull(), 0).otherwise(F.size("__line_gone")).alias("n_removed"),
    )
    return out.withColumn("__line_new", new)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_removed.

    Lines end at a newline; they are compared with spaces trimmed and joined and A-Z lower-cased.
    ``source`` is the site, where null is a site of its own, as the empty one. The first place of a
    boilerplate line, by doc_id (null last) and line number, stays; rows that share a doc_id share its
    places. Needs doc_id, text and source; all other columns are kept, ``n_chars`` follows the new text if there
    is one, n_lines and n_removed of the input are replaced; names that begin with ``__line_`` are
    reserved. A null text stays null with no lines. Empty tables give empty results.
    """
    lines = pick(docs, "doc_id", "text", "source").select("doc_id", *_row_key(), F.coalesce("source", F.lit("")).alias("site"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = cut(in_arrow(lines, _lines(min_chars), f"doc_id {kind}, r1 long, r2 long, site string, pos int, k1 long, k2 long"), "places")
    lines = places.withColumn("place", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos"))
    bad = boilerplate(lines, min_sites)
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    kept = [c for c in docs.columns if c not in clash]
    docs = docs.drop(*clash)
    if bad.count() <= broadcast_lines:
        out = docs.withColumn("__line_new", _rewriter(bad.toArrow(), min_chars)("doc_id", "text"))
    else:
        out = _joined(docs, lines, bad)
    forget(places)
    forget(bad)
    changed = {"text": F.col("__line_new.text"), "n_lines": F.col("__line_new.n_lines"), "n_removed": F.col("__line_new.n_removed")}
    if "n_chars" in docs.columns:
        n = F.char_length("__line_new.text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("__line_new.n_removed") > 0, n).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*(F.col("`" + c.replace("`", "``") + "`") for c in [*kept, "n_lines", "n_removed"]))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
k AS (
  SELECT *, translate(trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (
  SELECT key, min((doc_id, pos)) AS first FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT site) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, b.key IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS gone FROM k LEFT JOIN b USING (key)),
t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": SQL}
