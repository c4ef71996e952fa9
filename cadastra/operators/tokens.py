"""Tagged tokens with their context, and the statistics of one class of them (verbs)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.operators.notices import running
from cadastra.operators.stages import settle

#: Tags of locations; a verb's tag starts with v; w marks punctuation.
LOCATION_TAGS = ["LOC", "ns", "s"]
VERB_MARK = "v"
PUNCTUATION_TAG = "w"
NEAR = 3


#: What can be asked of a token, in order.
CONTEXT = [
    "token_index", "token", "pos", "is_verb", "is_location", "token_position_ratio", "prev_token", "prev_pos", "next_token", "next_pos",
    "is_sentence_initial", "is_after_punctuation", "near_location",
]


def tag_sentences(sents: DataFrame, tokens: Column, tag: Callable[[Column], Column]) -> DataFrame:
    """``sents``, a row per sentence, with the arrays ``tokens`` and ``tags``.

    ``tokens`` is an array expression, ``tag`` maps a token to its tag. What is asked of single tokens
    or of sentences is taken from these arrays, so none of it shuffles.
    """
    return sents.withColumn("tokens", tokens).withColumn("tags", F.transform("tokens", tag))


class Flat:
    """The tokens of the sentences of an Arrow batch one after the other, with what is asked of them. Sentences without tokens are left out."""

    def __init__(self, batch: pa.RecordBatch, near: int, location_tags: list[str]):
        batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch["tags"]), 0), 0))
        self.batch, self.near, self.location_tags = batch, near, location_tags
        size = pc.list_value_length(batch["tags"]).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(size)), size)
        self.n, self.start = size[self.row], (np.cumsum(size) - size)[self.row]
        self.at = np.arange(len(self.row))
        self.i = self.at - self.start + 1
        self.tokens, tags = batch["tokens"].flatten(), batch["tags"].flatten().dictionary_encode()
        self.tag, self.kinds = tags.indices.to_numpy(zero_copy_only=False), tags.dictionary.to_pylist()
        self.tags = tags.cast("string")

    def is_tag(self, test: Callable[[str], bool]) -> np.ndarray:
        return np.array([bool(test(k)) for k in self.kinds], bool)[self.tag]

    def _beside(self, values: pa.Array, step: int, at: np.ndarray) -> pa.Array:
        """The values a step away inside the sentence, '' beyond its ends."""
        inside = (self.i[at] + step >= 1) & (self.i[at] + step <= self.n[at])
        return pa.concat_arrays([values, pa.array([""], "string")]).take(pa.array(np.where(inside, at + step, len(values))))

    def get(self, field: str, at: np.ndarray) -> pa.Array:
        """A field of the tokens at these places."""
        i, n = self.i[at], self.n[at]
        if field in ("token", "pos"):
            return (self.tokens if field == "token" else self.tags).take(pa.array(at))
        if field in ("prev_token", "prev_pos", "next_token", "next_pos"):
            return self._beside(self.tokens if field.endswith("token") else self.tags, -1 if field.startswith("prev") else 1, at)
        if field == "token_position_ratio":  # half-even at 6 places, in whole numbers
            q, r = np.divmod(i * 1_000_000, n)
            return pa.array((q + ((2 * r > n) | ((2 * r == n) & (q % 2 == 1)))) / 1e6)
        if field == "near_location":
            so_far = np.concatenate([[0], np.cumsum(self.is_tag(self.location_tags.__contains__))])
            low, high = np.maximum(at - self.near, self.start[at]), np.minimum(at + self.near + 1, self.start[at] + n)
            value = so_far[high] > so_far[low]
        elif field == "is_after_punctuation":
            value = (i > 1) & self.is_tag(PUNCTUATION_TAG.__eq__)[at - 1]
        else:
            value = {
                "token_index": lambda: i,
                "is_verb": lambda: self.is_tag(lambda x: x.startswith(VERB_MARK))[at],
                "is_location": lambda: self.is_tag(self.location_tags.__contains__)[at],
                "is_sentence_initial": lambda: i == 1,
            }[field]()
        return pa.array(value.astype(np.int32))


TYPES = {f: "int" for f in CONTEXT} | {f: "string" for f in ("token", "pos", "prev_token", "prev_pos", "next_token", "next_pos")} | {"token_position_ratio": "double"}
#: Rows of an Arrow batch that goes back to Spark.
BATCH = 50_000


def _schema(df: DataFrame, keep: list[str], fields: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in [*((k, df.schema[k].dataType.simpleString()) for k in keep), *fields.items()])


def token_context(
    tagged: DataFrame, fields: list[str] = CONTEXT, near: int = NEAR, location_tags: list[str] = LOCATION_TAGS, keep: list[str] | None = None
) -> DataFrame:
    """One row per token of ``tag_sentences`` with the columns of the sentence that ``keep`` names (all
    but the arrays, if none are named) and the fields that are asked for: prev_token, prev_pos,
    next_token, next_pos ('' at the ends), is_verb, is_location, token_position_ratio (6 places),
    is_sentence_initial, is_after_punctuation, near_location (a location up to ``near`` tokens
    away, or itself). Only these are made, for whole Arrow batches of sentences at once."""
    keep = [c for c in tagged.columns if c not in ("tokens", "tags")] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat(batch, near, location_tags)
            for i in range(0, len(flat.at), BATCH):
                at = flat.at[i : i + BATCH]
                row = pa.array(flat.row[at])
                yield pa.RecordBatch.from_pydict({k: flat.batch[k].take(row) for k in keep} | {f: flat.get(f, at) for f in fields})

    return tagged.select(*keep, "tokens", "tags").mapInArrow(run, _schema(tagged, keep, {f: TYPES[f] for f in fields}))


def token_offsets(sentence: Column, tokens: Column) -> Column:
    """0-based offset of each token: its first place at or after the end of the one before, or
    that end itself where it isn't found."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("cursor"))

    def step(acc: Column, token: Column) -> Column:
        found = F.position(token, sentence, acc["cursor"] + 1) - 1
        here = F.when(found < 0, acc["cursor"]).otherwise(found)
        return F.struct(F.concat(acc["at"], F.array(here)).alias("at"), (here + F.char_length(token)).alias("cursor"))

    return F.aggregate(tokens, start, step, lambda acc: acc["at"])


def sentence_stats(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Per sentence with tokens: token, verb and location counts, verbs in order, and tags as
    ``tag:count`` joined by ``;`` in tag order, all from the sentence's own arrays."""
    pairs = F.filter(F.arrays_zip("tokens", "tags"), lambda x: x["tags"].startswith(VERB_MARK))
    kinds = F.array_sort(F.array_distinct("tags"))
    count = lambda test: F.size(F.filter("tags", test)).cast("long")
    return tagged.where(F.size("tags") > 0).select(
        *keys,
        F.size("tags").cast("long").alias("token_count"),
        count(lambda x: x.startswith(VERB_MARK)).alias("verb_count"),
        count(lambda x: x.isin(LOCATION_TAGS)).alias("location_count"),
        F.array_join(F.transform(pairs, lambda x: x["tokens"]), " / ").alias("verbs"),
        F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit(":"), F.size(F.filter("tags", lambda x: x == k)).cast("string"))), ";").alias("pos_counts"),
    )


#: Kinds of rows of ``verb_rows``: a verb's place; a verb of a sentence, once; a frame of a sentence, once.
PLACE, VERB, FRAME = 0, 1, 2
RATES = ["token_position_ratio", "is_sentence_initial", "is_after_punctuation", "near_location"]


def verb_rows(tagged: DataFrame, keep: list[str], near: int = NEAR, location_tags: list[str] = LOCATION_TAGS) -> DataFrame:
    """``keep``, kind, verb, frame (``prevtag:prev <- verb -> nexttag:next``), pos and the rates' fields of
    every verb, and of each sentence its verbs and frames once more, so that sentences are counted
    without a distinct count. Made for whole Arrow batches of sentences at once."""
    fields = {"kind": "int", "verb": "string", "frame": "string", "pos": "string"} | {f: TYPES[f] for f in RATES}

    def rows(flat: Flat, at: np.ndarray, kind: int, made: dict[str, pa.Array]) -> pa.RecordBatch:
        none = {k: pa.nulls(len(at), {"int": "int32"}.get(t, t)) for k, t in fields.items()}
        row = pa.array(flat.row[at])
        return pa.RecordBatch.from_pydict({k: flat.batch[k].take(row) for k in keep} | none | {"kind": pa.array(np.full(len(at), kind, np.int32))} | made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat(batch, near, location_tags)
            at = flat.at[flat.is_tag(lambda x: x.startswith(VERB_MARK))]
            if not len(at):
                continue
            verb, pp, pt, np_, nt = (flat.get(f, at) for f in ("token", "prev_pos", "prev_token", "next_pos", "next_token"))
            frame = pc.binary_join_element_wise(pp, ":", pt, " <- ", verb, " -> ", np_, ":", nt, "")
            yield rows(flat, at, PLACE, {"verb": verb, "frame": frame, "pos": flat.get("pos", at)} | {f: flat.get(f, at) for f in RATES})
            v, f = verb.dictionary_encode(), frame.dictionary_encode()
            own = flat.row[at] * len(v.dictionary) + v.indices.to_numpy()
            first = np.unique(own, return_index=True)[1]
            yield rows(flat, at[first], VERB, {"verb": verb.take(pa.array(first))})
            first = np.unique(own * len(f.dictionary) + f.indices.to_numpy(), return_index=True)[1]
            yield rows(flat, at[first], FRAME, {"verb": verb.take(pa.array(first)), "frame": frame.take(pa.array(first))})

    return tagged.select(*keep, "tokens", "tags").mapInArrow(run, _schema(tagged, keep, fields))


def _mean(x: Column | str) -> Column:
    return F.bround(F.avg(x), 6)


def _with_total(df: DataFrame, value: str, name: str, how=F.sum) -> DataFrame:
    """With one figure of the whole table, which every row gets from a table of one row."""
    total = df.agg(how(value).alias(name)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def verb_frequency(rows: DataFrame, year: str = "year", min_count: int = 1) -> DataFrame:
    """Per verb of ``verb_rows``: count, share of all verb tokens (before ``min_count``), sentences, first and
    last year, tags, mean rates, and rank and cumulative share by falling count."""
    at, in_sentence = F.col("kind") == PLACE, F.col("kind") == VERB
    freq = rows.where(at | in_sentence).groupBy("verb").agg(
        F.count_if(at).alias("count"),
        F.count_if(in_sentence).alias("sentence_count"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.array_join(F.array_sort(F.collect_set("pos")), "/").alias("pos_tags"),
        _mean("is_sentence_initial").alias("initial_rate"),
        _mean("is_after_punctuation").alias("after_punctuation_rate"),
        _mean("near_location").alias("near_location_rate"),
        # a decimal mean: the sum doesn't depend on the order of the rows
        _mean(F.col("token_position_ratio").cast("decimal(9,6)")).cast("double").alias("avg_position_ratio"),
    )
    freq = _with_total(settle(freq), "count", "_all").withColumn("frequency_ratio", F.bround(F.col("count") / F.col("_all"), 6)).where(F.col("count") >= min_count)
    freq = running(freq, [F.desc("count"), F.asc("verb")], "count", "rank", "cumulative_count").withColumn("rank", F.col("rank").cast("int"))
    return _with_total(freq.drop("_all"), "count", "_all").withColumn("cumulative_ratio", F.bround(F.col("cumulative_count") / F.col("_all"), 6)).drop("_all")


def context_frames(rows: DataFrame, year: str = "year", min_count: int = 1) -> DataFrame:
    """Counts of the frames of ``verb_rows``."""
    at, in_sentence = F.col("kind") == PLACE, F.col("kind") == FRAME
    out = rows.where(at | in_sentence).groupBy("verb", "frame").agg(
        F.count_if(at).alias("count"),
        F.count_if(in_sentence).alias("sentence_count"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        _mean("near_location").alias("near_location_rate"),
    )
    return out.where(F.col("count") >= min_count)


def verb_cooccurrence(tagged: DataFrame, sentence_keys: list[str], sentence: str, min_count: int = 1) -> DataFrame:
    """Unordered pairs of different verbs of a sentence: summed counts, sentences, first example.

    Pairs come from each sentence's own distinct verbs, so their number is bounded by it. Only sentences
    with a pair are joined to the examples at the end.
    """
    verbs = F.array_sort(F.transform(F.filter(F.arrays_zip("tokens", "tags"), lambda x: x["tags"].startswith(VERB_MARK)), lambda x: x["tokens"]))
    per = tagged.select(*sentence_keys, F.col(sentence).alias("example_sentence"), verbs.alias("_w"))
    # the verbs in order, each with its number: the distance of its first place from the next verb's
    per = per.withColumn("_d", F.array_distinct("_w"))
    firsts = F.concat(F.transform("_d", lambda v: F.array_position("_w", v)), F.array(F.size("_w").cast("long") + 1))
    numbered = F.transform("_d", lambda v, i: F.struct(v.alias("verb"), (F.get("_at", i + 1) - F.get("_at", i)).alias("tf")))
    per = per.withColumn("_at", firsts).select(*sentence_keys, "example_sentence", numbered.alias("_v"))
    # settled before the filter, which would make the tokens once more
    per = settle(per).where(F.size("_v") > 1)
    each = per.select(F.struct(*sentence_keys).alias("_k"), "_v", F.posexplode("_v").alias("_i", "_a"))
    rows = each.select("_k", "_a", F.inline(F.slice("_v", F.col("_i") + 2, F.size("_v")))).select(
        F.col("_a.verb").alias("verb_a"), F.col("verb").alias("verb_b"), (F.col("_a.tf") + F.col("tf")).alias("score"), "_k"
    )
    out = rows.groupBy("verb_a", "verb_b").agg(
        F.sum("score").alias("cooccurrence_score"),
        F.count("*").alias("sentence_count"),
        F.min("_k").alias("_k"),
    )
    out = out.where(F.col("sentence_count") >= min_count).select("*", *(F.col(f"_k.{k}").alias(k) for k in sentence_keys)).drop("_k")
    return out.join(per.select(*sentence_keys, "example_sentence"), sentence_keys).drop(*sentence_keys)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group in a total order; Spark limits groups before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def examples(rows: DataFrame, sents: DataFrame, sentence_keys: list[str], sentence: str, n: int) -> DataFrame:
    """(verb, example_sentences): the first ``n`` sentences with each verb of ``verb_rows``, joined by ||."""
    first = top_per_group(rows.where(F.col("kind") == VERB).select("verb", *sentence_keys), ["verb"], [F.col(k) for k in sentence_keys], n)
    first = first.join(sents.select(*sentence_keys, F.col(sentence).alias("_s")), sentence_keys)
    ordered = F.array_sort(F.collect_list(F.struct(*sentence_keys, "_s")))
    return first.groupBy("verb").agg(F.array_join(F.transform(ordered, lambda x: x["_s"]), " || ").alias("example_sentences"))


def relation_candidates(freq: DataFrame, frames: DataFrame, shown: DataFrame, n_frames: int = 5) -> DataFrame:
    """Verbs scored as relation words: log frequency times weighted context rates (6 places), with
    their most frequent frames and example sentences."""
    freq = _with_total(freq, "count", "_most", F.max)
    frequency = F.log1p("count") / F.log1p(F.greatest("_most", F.lit(1)))
    context = (
        0.45 * F.col("near_location_rate") + 0.25 * F.col("after_punctuation_rate") + 0.20 * F.col("initial_rate") + 0.10 * (1 - F.col("avg_position_ratio"))
    )
    order = [F.desc("count"), F.asc("frame")]
    best = top_per_group(frames, ["verb"], order, n_frames).groupBy("verb").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "frame"))), lambda x: x["frame"]), " || ").alias(
            "representative_frames"
        )
    )
    scored = freq.withColumn("relation_score", F.bround(frequency * context, 6))
    joined = scored.join(best, "verb", "left").join(shown, "verb", "left")
    return joined.select(
        F.col("verb").alias("candidate_relation"),
        "relation_score",
        "count",
        "frequency_ratio",
        "sentence_count",
        "first_year",
        "last_year",
        "near_location_rate",
        "initial_rate",
        "after_punctuation_rate",
        F.coalesce("representative_frames", F.lit("")).alias("representative_frames"),
        F.coalesce("example_sentences", F.lit("")).alias("example_sentences"),
    )


def token_overview(tagged: DataFrame, source: str = "source_file") -> DataFrame:
    """Sources, sentences, tokens, verbs, different verbs and locations of ``tag_sentences`` in a row."""
    count = lambda test: F.size(F.filter("tags", test)).cast("long")
    words = F.array_distinct(F.transform(F.filter(F.arrays_zip("tokens", "tags"), lambda x: x["tags"].startswith(VERB_MARK)), lambda x: x["tokens"]))
    per = tagged.where(F.size("tags") > 0).select(
        F.col(source).alias("_s"), F.size("tags").cast("long").alias("n"), count(lambda x: x.startswith(VERB_MARK)).alias("v"), count(lambda x: x.isin(LOCATION_TAGS)).alias("l"), words.alias("w")
    )
    per = settle(per)
    totals = per.agg(
        F.countDistinct("_s").alias("source_count"),
        F.count("*").alias("sentence_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("token_count"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("verb_count"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("location_count"),
        F.lit(1).alias("_one"),
    )
    verbs = per.select(F.explode("w").alias("w")).agg(F.countDistinct("w").alias("distinct_verb_count"), F.lit(1).alias("_one"))
    return totals.join(verbs, "_one").drop("_one")  # a row each
