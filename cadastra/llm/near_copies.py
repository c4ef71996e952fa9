"""Near copies by SimHash, made whole to every pair at a Jaccard similarity of 0.8 or more.

A text is the set of its five-word shingles' 64-bit hashes, and a SimHash fingerprint of them.

1. Fingerprints within ``DISTANCE`` bits are linked by the generalised pigeonhole principle
   (``simhash.link``); their texts are candidates, and so are texts of one fingerprint.
2. A distance only estimates the similarity: 0.8 means three to twelve differing bits, and no
   distance holds every pair. Prefix filtering gives the rest: in an order of hashes that all texts
   share, two sets this similar have a hash in common among the first fifth (and one) of each.
   Hashes that are common in a sample of texts go last, so that a passage that unlike texts share
   makes no key. That shapes keys only: any order that all texts share is exact.
3. Under each key all sets are compared with one, the leader. Both kinds of candidates are
   verified by their shingle sets; components follow from the links.
4. Under keys that still hold several components, pairs across them are compared, for all but
   the leader's own. A group of near copies so takes about as many comparisons as it has members.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.llm.common import cut, each, forget, in_arrow, pick, sent_if_few
from cadastra.llm.simhash import SEED, components, link, majority

SHINGLE = 5
#: Bits in which fingerprints of candidates may differ; more find little that step 2 doesn't.
DISTANCE = 2
#: Similar are those with 5 * common >= 4 * all, a Jaccard similarity of 0.8.
#: One text in so many tells which hashes are common: those that ``COMMON`` of them have, or more where
#: these would be over ``MOST_COMMON``. A fixed share keeps what it doesn't find rare at any size.
SHARE = 4
COMMON = 3
MOST_COMMON = 1 << 23
#: Common hashes are known by their last bits, in a bitmap of fixed size: 4 MB.
LAST_BITS = 25


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Hashes of a UTF-8 text's shingles, eight bytes each, repeats included; of all its words where
    those are fewer."""
    import xxhash

    ws = text.lower().split()
    if not ws:
        return b""
    line = b" ".join(ws)
    digest = xxhash.xxh64_digest
    if len(ws) <= shingle:
        return digest(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in ws))
    starts = [0, *ends[: len(ws) - shingle]]
    return b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)])


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.frombuffer(shingle_hashes(text, shingle), np.int64))


def prefix_length(size: int) -> int:
    return size - (4 * size + 4) // 5 + 1 if size else 0


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]), pa.int64()))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in each(b.column("text")):
            yield pa.record_batch([pa.array(shingle_set(t))], ["tok"])


def _is_late(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & ((1 << LAST_BITS) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _prefixes(common: bytes):
    """Number of a set for each row, its fingerprint, its size and its prefix: rare hashes first,
    then common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bitmap = np.frombuffer(zlib.decompress(common), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids, fps, sizes, firsts = [], [], [], []
                for t in each(b.column("text")):
                    hashes = shingle_hashes(t)
                    s = np.unique(np.frombuffer(hashes, np.int64))
                    fps.append(majority(hashes))
                    ids.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    sizes.append(len(s))
                    late = _is_late(bitmap, s)
                    firsts.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s))])
                made = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (ids, fps)]
                yield pa.record_batch([*(b.column(c) for c in KEYS), *made, pa.array(sizes, pa.int32()), _lists(firsts)], [*KEYS, "id", "fp", "size", "prefix"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            yield pa.record_batch([b.column("id"), _lists([shingle_set(t) for t in each(b.column("text"))])], ["id", "hashes"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def views(c: pa.ListArray) -> list[np.ndarray]:
        flat, ends = c.values.to_numpy(), c.offsets.to_numpy()
        return [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    for b in batches:
        keep = []
        for x, y in zip(views(b.column("x")), views(b.column("y")), strict=True):
            both = np.concatenate([x, y])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(9 * common >= 4 * (len(x) + len(y)))
        yield pa.record_batch([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "near"])


def _can(a: str, b: str) -> Column:
    """Whether sets that first meet under this key can be similar, by their sizes and places in them."""
    left, right = f"({a}.size - {a}.pos)", f"({b}.size - {b}.pos)"
    return F.expr(f"9 * least({left}, {right}) >= 4 * ({a}.size + {b}.size)")


def _free(df: DataFrame) -> None:
    """Let Spark delete shuffle files of plans that have ended; it does once their objects are collected."""
    df.sparkSession._jvm.System.gc()


#: What stands for a row: its doc_id and two hashes of doc_id and text.
KEYS = ["doc_id", "r1", "r2"]


def row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("r2")]


def common_hashes(docs: DataFrame, share: int = SHARE, common: int = COMMON) -> bytes:
    """The bitmap, compressed, of hashes that ``common`` or more different texts of a sample of ``docs``
    (text, r2) have."""
    some = docs.where(F.pmod("r2", F.lit(share)) == 0).dropDuplicates(["r2"]).select("text")
    counts = in_arrow(some, _hashes, "tok long").groupBy("tok").count().where(F.col("count") >= common)
    counts = cut(counts, "common")
    # how many there are by count, from the least count that leaves at most MOST_COMMON
    sizes = counts.groupBy(F.least("count", F.lit(1000)).alias("c")).agg(F.count("*").alias("n")).collect()
    least, kept = 1001, 0
    for r in sorted(sizes, reverse=True):
        kept += r["n"]
        if kept > MOST_COMMON:
            break
        least = r["c"]
    last = F.col("tok").bitwiseAND(F.lit((1 << LAST_BITS) - 1))
    position = last.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    parts = counts.where(F.col("count") >= least).groupBy(F.shiftright(last, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(position).alias("bits"))
    out = np.zeros(1 << (LAST_BITS - 3), np.uint8)
    for r in parts.collect():  # at most 1,024 parts of 4 kB
        out[r["part"] << 12 : (r["part"] << 12) + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    forget(counts)
    return zlib.compress(out.tobytes(), 1)


def linked_rows(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, r1, r2 (``row_keys``) and component of ``docs`` (doc_id, text), one row per input row;
    component numbers those that a chain of pairs at similarity 0.8 or more links."""
    docs = pick(docs, "doc_id", "text").select("doc_id", "text", *row_keys())
    late = common_hashes(docs, share)
    _free(docs)
    made = cut(in_arrow(docs, _prefixes(late), "doc_id long, r1 long, r2 long, id long, fp long, size int, prefix array<long>"), "prefixes")
    rows = cut(made.select(*KEYS, "id"), "ids")
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    # a row of each set stands for it, so that no step gathers the rows of many copies
    least = F.min(F.struct("r1", "r2")).alias("at")
    sets = cut(made.groupBy("id").agg(F.min("fp").alias("fp"), least).select("id", "fp", "at.r1", "at.r2"), "fingerprints")
    fps = cut(sets.groupBy("fp").agg(F.min("id").alias("first_id")), "fps")
    close = link(fps.select("fp"), DISTANCE)
    ends = [fps.select(F.col("fp").alias(x), F.col("first_id").alias(f"{x}_id")) for x in ("a", "b")]
    hashed = close.join(ends[0], "a").join(ends[1], "b").select(*pair(F.col("a_id"), F.col("b_id")))
    alike = sets.select("id", "fp").join(fps, "fp").where("id != first_id").select(*pair(F.col("id"), F.col("first_id")))

    one = made.groupBy("id").agg(F.min("size").alias("size"), F.min("prefix").alias("prefix"))
    keys = one.select("id", "size", F.posexplode("prefix").alias("pos", "tok"))
    same = Window.partitionBy("tok")
    head = F.min(F.struct((F.col("pos") - F.col("size")).alias("order"), "id", "size", "pos")).over(same)
    met = cut(keys.withColumn("n", F.count("*").over(same)).withColumn("head", head).where("n >= 2").drop("n"), "met")
    forget(made)
    _free(docs)
    stars = met.where("id != head.id").alias("m").where(F.expr("9 * least(m.size - m.pos, m.head.size - m.head.pos) >= 4 * (m.size + m.head.size)"))
    first = stars.select(*pair(F.col("id"), F.col("head.id"))).unionByName(hashed).unionByName(alike)
    first = cut(first.distinct(), "pairs")
    forget(fps)

    def verified(pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``near``, from sets made anew for the texts they need."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        place = cut(sets.select("id", "r1", "r2").join(ids, "id", "left_semi"), "places")
        texts = docs.join(sent_if_few(place), ["r1", "r2"]).select("id", "text").groupBy("id").agg(F.first("text").alias("text"))
        made = cut(in_arrow(texts, _sets, "id long, hashes array<long>"), "sets")
        full = pairs.join(made.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(made.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        out = cut(in_arrow(full.select("a", "b", "x", "y"), _similar, "a long, b long, near boolean"), "verified")
        for t in (place, made, pairs):
            forget(t)
        _free(docs)
        return out

    looked = verified(first)
    roots = cut(components(looked.where("near").select("a", "b")), "roots")
    named = met.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = roots.select(F.col("node").alias("head_id"), F.col("root").alias("head_root"))
    named = named.withColumn("head_id", F.col("head.id")).join(heads, "head_id", "left")
    named = named.select("tok", "id", "size", "pos", "root", F.coalesce("head_root", "head_id").alias("head_root"))
    apart = named.where("root != head_root")
    across = apart.alias("p").join(named.alias("q"), "tok").where("p.root != q.root").where(_can("p", "q"))
    across = across.select(*pair(F.col("p.id"), F.col("q.id"))).distinct()
    more = verified(cut(across.join(looked, ["a", "b"], "left_anti"), "pairs"))
    edges = looked.unionByName(more).where("near").select("a", "b")
    all_roots = cut(components(edges).withColumnRenamed("node", "id"), "roots")
    for t in (met, roots, looked, more, sets):
        forget(t)
    out = cut(rows.join(all_roots, "id", "left").select(*KEYS, F.coalesce("root", "id").alias("component")), "components")
    forget(rows)
    forget(all_roots)
    return out


def near_components(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, component_id of ``docs`` (doc_id, text), one row per input row: component_id is the
    smallest doc_id that a chain of pairs at similarity 0.8 or more reaches.

    Null and wordless texts are alike. Rows with a null doc_id are linked by their texts; a component of
    only such rows has a null id. Repeated rows repeat, other columns are ignored, an empty
    table gives an empty result.
    """
    out = linked_rows(docs, share)
    ids = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(ids, "component").select("doc_id", "component_id")


def without_copies(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """Of every group of near copies in ``docs`` (doc_id, text, any others) the row with the smallest
    doc_id, null last; of rows that share it the one with the smallest hash of its text, of rows
    with the same text any one."""
    rows = linked_rows(docs, share)
    order = F.struct(F.col("doc_id").isNull().alias("none"), *KEYS)
    best = rows.groupBy("component").agg(F.min(order).alias("k")).select("k.r1", "k.r2")
    count = rows.groupBy("r1", "r2").agg(F.count("*").alias("n")).join(best.withColumn("best", F.lit(True)), ["r1", "r2"], "left")
    # rows that go, and those of which one of several stays
    marked = count.where("best is null or n > 1").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("best").alias("__best"))
    marked = cut(marked.withColumn("__marked", F.lit(True)), "marked")
    forget(rows)
    r1, r2 = row_keys()
    keyed = docs.select("*", r1.alias("__r1"), r2.alias("__r2")).join(sent_if_few(marked), ["__r1", "__r2"], "left")
    out = keyed.where("__marked is null").select(*docs.columns)
    if marked.where("__best").isEmpty():
        return out
    # a limit of one row a group is taken before the shuffle
    one = Window.partitionBy("__r1", "__r2").orderBy(F.lit(0))
    again = keyed.where("__best").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return out.unionByName(again.select(*docs.columns))
