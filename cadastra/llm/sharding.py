"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group that stays in one shard, unless it fills over a quarter of one; such
a group is split by doc_id. Groups are packed one by one while they are at most ``GRAIN`` a
shard; where there are more, all but the large ones are first hashed into that many cells, so
what the driver packs is bounded whatever the table's size. Every item goes to the shard where the dot
product of its size vector with the residual capacity is highest; swaps then even out
what is left, in all three sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadastra.llm.common import cut, forget, pick, table

SHARDS = 24
#: Cells per shard; a group over a cell's share of a shard's capacity gets cells of its own.
GRAIN = 256
#: A group over 1 / SPLIT of a shard's capacity is packed in parts.
SPLIT = 4


#: What an uneven sum counts in swaps: bytes, tokens, rows.
WEIGHTS = np.array([16.0, 1.0, 1.0])


def pack(sizes: np.ndarray, shards: int, swaps: int = 40) -> np.ndarray:
    """Shard of each row of ``sizes`` (items x three sums): largest first, to the highest dot
    product of size and residual capacity; then up to ``swaps`` a shard of the best exchange of
    two items, or move of one, between the fullest shard in one of the sums and the emptiest, or, where
    that gains nothing, between one of these and another."""
    total = np.maximum(sizes.sum(axis=0), 1)
    share = sizes / (total / shards)
    room = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int32)
    for i in np.lexsort((np.arange(len(sizes)), -share.max(axis=1))):
        out[i] = int(np.argmax(room @ share[i]))
        room[out[i]] -= share[i]
    if not len(sizes):
        return out
    load = 1 - room
    for _ in range(swaps * shards):
        apart = WEIGHTS * (load.max(axis=0) - load.min(axis=0))
        for hi, lo in _pairs(load, np.argsort(-apart, kind="stable")):
            found = _exchange(share, np.flatnonzero(out == hi), np.flatnonzero(out == lo), load[hi] - load[lo])
            if found:
                break
        else:
            break
        a, b = found
        shift = (share[a] if a >= 0 else 0) - (share[b] if b >= 0 else 0)
        load[hi] -= shift
        load[lo] += shift
        for item, to in ((a, lo), (b, hi)):
            if item >= 0:
                out[item] = to
    return out


def _pairs(load: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    for kind in kinds:
        order = np.argsort(load[:, kind], kind="stable")
        yield int(order[-1]), int(order[0])
    for kind in kinds:
        order = np.argsort(load[:, kind], kind="stable")
        for k in order[1:-1]:
            yield int(order[-1]), int(k)
            yield int(k), int(order[0])


def _exchange(share: np.ndarray, own: np.ndarray, other: np.ndarray, gap: np.ndarray) -> tuple[int, int] | None:
    """The items to exchange (-1: none) that lower the weighted squares of both shards' sums most."""
    none = np.zeros((1, share.shape[1]))
    a, b = np.concatenate([share[own], none]), np.concatenate([share[other], none])
    worth = np.zeros((len(a), len(b)))
    for d, w in enumerate(WEIGHTS):  # 2 w s (s - gap) for a shift s
        shift = a[:, d, None] - b[None, :, d]
        worth += 2 * w * shift * (shift - gap[d])
    best = int(worth.argmin())
    if worth.flat[best] >= -1e-12:
        return None
    i, j = divmod(best, len(b))
    return (int(own[i]) if i < len(own) else -1, int(other[j]) if j < len(other) else -1)


def shard(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot for every row of ``docs`` (doc_id, text).

    size is the text's UTF-8 bytes plus 8, tokens its runs of non-space. A null text counts as
    empty. Slots count from 0 without gaps in each shard, by cell and doc_id; rows that tie
    take any order among themselves. Repeated rows each get a slot; where rows of one doc_id and
    text are more than a chunk, they are dealt to several. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        F.xxhash64(text).alias("g"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("u"),  # written once; only tells rows of one doc_id apart
    )
    rows = cut(rows, "sizes")
    kinds = ["size", "tokens", "rows"]
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    limits = [max((total[k] or 0) / shards / grain, 1) for k in kinds]
    share = F.greatest(*(F.col(k) / F.lit(x) for k, x in zip(kinds, limits, strict=True)))
    groups = cut(rows.groupBy("g").agg(*sums).withColumn("share", share), "groups")
    few = groups.count() <= shards * grain
    # a group over the limit in one of three sums: at most 3 * shards * grain groups and chunks
    large = groups if few else groups.where("rows > 1 and share > 1")
    large = large.select("g", F.when(F.col("rows") > 1, F.greatest(F.ceil("share"), F.lit(1))).otherwise(1).cast("int").alias("chunks")).collect()
    forget(groups)
    # ids of which the rows alone are more than a chunk: no more than there are chunks
    split = spark.createDataFrame([(r["g"], r["chunks"]) for r in large if r["chunks"] > 1], "g long, chunks int")
    same = rows.join(F.broadcast(split), "g").groupBy("g", "doc_id").agg(*sums).where(F.col("rows") > 1).withColumn("share", share).where("share > 1")
    same = [(r["g"], r["doc_id"]) for r in same.select("g", "doc_id").collect()]
    kind = rows.schema["doc_id"].dataType.simpleString()
    same = spark.createDataFrame(same, f"g2 long, id2 {kind}").withColumn("many", F.lit(True))
    rows = rows.join(F.broadcast(same), (F.col("g") == F.col("g2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left")
    by_id = F.when(F.col("many"), F.xxhash64("u")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("by_id", by_id).drop("g2", "id2", "many", "u")
    base, first, item_of = shards * grain, {}, {}
    for r in sorted(large):
        first[r["g"]] = base
        for j in range(r["chunks"]):  # a group's cells are one item, or as few as may be
            item_of[base + j] = base + j - j % max(1, grain // SPLIT)
        base += r["chunks"]
    chunked = spark.createDataFrame(
        [(r["g"], first[r["g"]], r["chunks"]) for r in large],
        T.StructType([T.StructField("g", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("chunks", T.IntegerType())]),
    )
    cell = F.when(
        F.col("first").isNotNull(), F.col("first") + F.pmod("by_id", F.col("chunks"))
    ).otherwise(F.pmod("g", F.lit(shards * grain)))
    rows = rows.join(F.broadcast(chunked), "g", "left").withColumn("cell", cell.cast("int")).drop("first", "chunks")
    cells = sorted(rows.groupBy("cell").agg(*sums).collect())
    items: dict[int, np.ndarray] = {}
    for r in cells:
        item = item_of.get(r["cell"], r["cell"])
        items[item] = items.get(item, np.zeros(3)) + [r[k] for k in kinds]
    placed = dict(zip(items, pack(np.array(list(items.values())).reshape(-1, 3), shards).tolist(), strict=True))
    taken, plan = [0] * shards, []
    for r in cells:
        s = placed[item_of.get(r["cell"], r["cell"])]
        plan.append((r["cell"], s, taken[s]))
        taken[s] += r["rows"]
    plan = spark.createDataFrame(
        plan,
        T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("before", T.LongType())]),
    )
    order = Window.partitionBy("cell").orderBy("doc_id", "text_crc32")
    rows = rows.withColumn("n", F.row_number().over(order)).join(F.broadcast(plan), "cell")
    return rows.select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("n") - 1).alias("slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict = {}
