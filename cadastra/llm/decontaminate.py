"""Benchmark decontamination by winnowing.

Both sides are cut into words. Every ``GRAM`` consecutive words are hashed and of each
window of ``span - GRAM + 1`` such hashes the smallest is kept, so two texts that share
``span`` words share a kept hash. Kept hashes of the corpus are joined with those of
the benchmark; a joined place is extended to the words around it, whose ``span``-word
windows are compared with the benchmark's as strings. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import let, pick, table, words

SPAN = 13
GRAM = 6
#: Up to this many benchmark windows, each counted once for every item that has it, the benchmark
#: side is broadcast (about 100 bytes each); beyond it both joins shuffle and adaptive execution splits
#: hot hashes.
BROADCAST_WINDOWS = 200_000


def _short_hash(ws: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), F.slice(ws, at, size))


def _over(values: Column, size: int, join) -> Column:
    """``join`` over each ``size`` neighbours, by doubling; the last size - 1 places are void."""

    def shifted(step: int):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), join)

    have = 1
    while have < size:
        step = min(have, size - have)
        values = let(values, shifted(step))
        have += step
    return values


#: A piece from which contexts are cut has 2 ** this many words; ``slice`` copies all that it cuts from.
PIECE = 6


def _records(ws: Column, keys: list[str], span: int, gram: int, short: list[int]) -> Column:
    """Array of structs: one for each kept place of the words ``ws``, and one with l = 0.

    A place is a 0-based word p at which the smallest hash of a window changes. In periodic
    texts it may stay the same for longer than a window; there every window's length is a
    place too. ctx holds the words of all windows that a place stands for."""
    width = span - gram + 1

    def places(m: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            changed = (i == 0) | (x != F.element_at(m, F.greatest(i, F.lit(1))))
            held = (i % width == 0) & (x == F.element_at(m, F.greatest(i + 1 - width, F.lit(1))))
            return F.when(changed | held, F.struct(i.alias("i"), x.alias("m")))

        return F.filter(F.transform(m, place), lambda x: x.isNotNull())

    def record(size: int, h: Column, p: Column, ctx: Column, n: Column) -> Column:
        names = ("l", "h", "p", "ctx", "n_words")
        return F.struct(*(c.alias(k) for k, c in zip(names, (F.lit(size), h, p, ctx, n), strict=True)))

    def spans(w: Column, n: Column) -> Column:
        hashes = _over(F.transform(w, lambda x: F.xxhash64(x)), gram, lambda a, b: F.xxhash64(a, b))
        minima = _over(hashes, width, lambda a, b: F.least(a, b))
        minima = F.slice(minima, 1, F.greatest(n - (span - 1), F.lit(0)))
        reach = span + 2 * width - 1
        pieces = F.transform(
            F.sequence(F.lit(0), F.shiftright(n, PIECE)), lambda k: F.slice(w, F.shiftleft(k, PIECE) + 1, (1 << PIECE) + reach)
        )

        def kept(x: Column, pieces: Column) -> Column:
            at = x["i"].bitwiseAND(F.lit((1 << PIECE) - 1)) + 1
            ctx = F.slice(F.element_at(pieces, F.shiftright(x["i"], PIECE) + 1), at, reach)
            return record(span, x["m"], x["i"], ctx, n)

        return let(pieces, lambda ps: F.transform(let(minima, places), lambda x: kept(x, ps)))

    def whole(w: Column, n: Column, size: int) -> Column:
        places = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: record(size, _short_hash(w, i, size), i - 1, F.slice(w, i, size), n))

    def all_records(w: Column, n: Column) -> Column:
        base = F.array(record(0, F.xxhash64(*keys), F.lit(-1), F.array().cast("array<string>"), n))
        return F.concat(base, spans(w, n), *(whole(w, n, size) for size in short))

    return let(ws, lambda w: let(F.size(w), lambda n: all_records(w, n)))


def _windows(df: DataFrame, *keep: str) -> DataFrame:
    """All l-word windows inside ctx, with their first word's place s; l = 0 gives one row without."""
    kind = "array<struct<s:int,win:string>>"
    inside = F.transform(
        F.sequence(F.lit(0), F.size("ctx") - F.col("l")),
        lambda j: F.struct(
            (F.col("p") + j).cast("int"), F.array_join(F.slice(F.col("ctx"), j + 1, F.col("l")), " ")
        ),
    ).cast(kind)
    none = F.array(F.struct(F.lit(-1), F.lit(None).cast("string"))).cast(kind)
    return df.select(*keep, F.inline(F.when(F.col("l") > 0, inside).otherwise(none)))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    broadcast_windows: int = BROADCAST_WINDOWS,
    row_hash: bool = False,
) -> DataFrame:
    """Words of ``docs`` (doc_id, text) that lie in a window of ``benchmark`` (item_id, text).

    Returns doc_id, n_words, n_hit, item_ids (array of string, sorted), spans (array of
    (s, l), the hit windows). A null or wordless text has no words and no hits; an item of
    fewer than ``span`` words is one window of its own length, a wordless item none. Rows
    that repeat both doc_id and text each get their row; a null doc_id is a value of its
    own. Other columns of the inputs are ignored. Empty tables give empty or hitless results.
    With ``row_hash`` there is also a column of that name, xxhash64 of doc_id and text.
    """
    items = pick(benchmark, "item_id", "text")

    def windows_of(w: Column, n: Column) -> Column:
        size = F.least(n, F.lit(span))
        return F.transform(
            F.sequence(F.lit(1), n - size + 1),
            lambda i: F.struct(size.alias("l"), F.array_join(F.slice(w, i, size), " ").alias("win")),
        )

    found = let(
        words(F.col("text")), lambda w: let(F.size(w), lambda n: F.when(n > 0, windows_of(w, n)))
    )
    item_windows = items.select("item_id", F.inline(found))
    facts = item_windows.agg(F.count("*").alias("n"), F.collect_set("l").alias("ls")).first()
    short = sorted(x for x in facts["ls"] if x < span)
    item_records = (
        items.select(F.inline(_records(words(F.col("text")), ["item_id"], span, gram, short)))
        .where((F.col("l") == span) | (F.col("l") > 0) & (F.col("l") == F.col("n_words")))
        .select("l", "h")
        .distinct()
        .withColumn("__known", F.lit(True))
    )
    owners = (
        item_windows.select("win", F.col("item_id").cast("string").alias("item"))
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    if facts["n"] <= broadcast_windows:
        item_records, owners = F.broadcast(item_records), F.broadcast(owners)

    places = pick(docs, "doc_id", "text").select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("__t"),
        F.inline(_records(words(F.col("text")), ["doc_id"], span, gram, short)),
    )
    places = places.join(item_records, ["l", "h"], "left").where("l = 0 or __known")
    hits = _windows(places, "doc_id", "__t", "n_words").join(owners, "win", "left")
    hits = hits.where("win is null or items is not null")
    one = F.when(
        F.col("win").isNotNull(),
        F.struct(F.col("s"), (F.length("win") - F.length(F.translate("win", " ", "")) + 1).alias("l")),
    )
    docs_out = hits.groupBy("doc_id", "__t", "n_words").agg(
        F.sum(F.col("win").isNull().cast("int")).alias("__rows"),
        F.array_sort(F.collect_set(one)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        state,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["s"] + x["l"] - F.greatest(x["s"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["s"] + x["l"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return docs_out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        "item_ids",
        "spans",
        *([F.col("__t").alias("row_hash")] if row_hash else []),
        F.explode(F.sequence(F.lit(1), F.col("__rows"))).alias("__copy"),
    ).drop("__copy")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw USING (win) WHERE dw.l = bw.l),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM (SELECT DISTINCT doc_id, i, l FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": SQL}
