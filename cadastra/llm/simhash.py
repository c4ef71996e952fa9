"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's
word shingles. Distinct fingerprints are linked if they differ in few bits:

1. Bit sums and bit-pair sums of all fingerprints give each bit's chance to differ and
   the bits' correlations. Correlated bits go into the same partition.
2. Thresholds T_i of the partitions with sum(T_i) = distance - partitions + 1 (and -1 for
   a partition that is left out) cover every linked pair in some partition. Dynamic
   programming picks those with the fewest expected candidates.
3. Each fingerprint's partition values, and those within T_i of them, are keys; pairs
   that meet under a key are verified by their bit count.
4. A key with over ``GROUP`` fingerprints yields no pairs: its members go to the exact
   ball method, where those within half the distance of a common 64-bit centre are linked
   to one of them. That takes a fixed number of rows per member, whatever the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import cut, each, forget, in_arrow, pick, table

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
GROUP = 64
#: A fingerprint of over a HOT-th of all rows is a hot one.
HOT = 1_000


def majority(hashes: bytes) -> int:
    """Of 64-bit big-endian hashes, the bits that are set in over half; 0 without any."""
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
    ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 without words."""
    import xxhash

    ws = text.lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = list(accumulate(len(w) + 1 for w in ws))
    digest = xxhash.xxh64_digest
    if len(ws) <= shingle:
        hashes = digest(line, SEED)
    else:
        starts = [0, *ends[: len(ws) - shingle]]
        hashes = b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)])
    return majority(hashes)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in each(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return run


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).astype(">i8")
        x = np.unpackbits(fps.view(np.uint8)).reshape(-1, BITS)[:, ::-1].astype(np.float32)
        for at in range(0, len(x), 1 << 16):
            part = x[at : at + (1 << 16)]
            total += np.rint(part.T @ part).astype(np.int64)
    names = ["bit", *(f"c{j}" for j in range(BITS))]
    yield pa.record_batch([pa.array(np.arange(BITS)), *(pa.array(total[:, j]) for j in range(BITS))], names)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set; over all of them."""
    schema = "bit long, " + ", ".join(f"c{j} long" for j in range(BITS))
    rows = in_arrow(fps.select("fp"), _bit_sums, schema).groupBy("bit").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(BITS))).collect()
    sums = np.zeros((BITS, BITS))
    for r in rows:
        sums[r["bit"]] = r[1:]
    return fps.count(), sums


def partitions(n: int, sums: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal width, correlated ones together."""
    p = np.diag(sums) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(sums / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < width:
            best = max(sorted(left), key=lambda b: corr[b, own].mean())
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def expected_candidates(n: int, sums: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For thresholds -1 to ``most``: expected pairs within it in these bits, and the probes."""
    p = np.diag(sums)[bits] / max(n, 1)
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    within = np.cumsum(chance)
    return [0.0, *(float(n * n / 2 * within[e] + n * sum(comb(len(bits), i) for i in range(e + 1))) for e in range(most + 1))]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds per partition, -1 or more, that add up to distance - partitions + 1 at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (so_far, chosen) in best.items():
            for e, c in enumerate(cost, -1):
                if total + e not in nxt or so_far + c < nxt[total + e][0]:
                    nxt[total + e] = (so_far + c, [*chosen, e])
        best = nxt
    return best[distance - len(costs) + 1]


def plan(n: int, sums: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) list over several partition counts."""
    found = []
    for m in range(max(2, distance), distance + 4):
        groups = partitions(n, sums, m)
        cost, ts = allocate([expected_candidates(n, sums, g, distance) for g in groups], distance)
        found.append((cost, m, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for e in range(most + 1) for c in combinations(bits, e)]


def link(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all pairs within ``distance`` bits.
    ``fps``: distinct ``fp`` (long), written to the shared folder by the caller."""
    n, sums = bit_statistics(fps)
    keys = []
    for k, (bits, t) in enumerate(plan(n, sums, distance)):
        mask = _signed(sum(1 << b for b in bits))
        own = F.col("fp").bitwiseAND(F.lit(mask))
        keys += [
            F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(x)).alias("key"), F.lit(x == 0).alias("own"))
            for x in _flips(bits, t)
        ]
    rows = fps.select("fp", F.inline(F.array(*keys)))
    met = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("some")).where("n >= 2 and some")
    rows = rows.join(met.drop("some"), ["part", "key"])
    small = rows.where(F.col("n") <= group)
    left = small.where("own").select("part", "key", F.col("fp").alias("a"))
    right = small.select("part", "key", F.col("fp").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["part", "key"]).where((F.col("a") != F.col("b")) & (differ <= distance))
    near, far = distance // 2, distance - distance // 2
    flips = _flips(list(range(BITS)), far)
    wide = sum(comb(BITS, e) for e in range(near + 1))
    big = rows.where(F.col("n") > group).select("fp").distinct()
    balls = big.select("fp", F.posexplode(F.array(*(F.lit(x) for x in flips))).alias("i", "flip"))
    centres = balls.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"), (F.col("i") < wide).alias("near"))
    stars = (
        centres.groupBy("v")
        .agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("bs"))
        .where("a is not null and size(bs) > 1")
        .select("a", F.explode("bs").alias("b"))
        .where("a != b")
    )
    edges = pairs.select("a", "b").unionByName(stars)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node reachable. Raises RuntimeError
    where ``rounds`` are not enough, which is far beyond the logarithm of any table's size.

    Large-star and small-star steps as joins with aggregated minima, so a hub's neighbours
    are never gathered in one row; each round is written to the shared folder."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    facts = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033))
    seen = now.agg(facts).first()[0]
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        nxt = cut(small.distinct(), "edges")
        forget(now)
        now, last = nxt, seen
        seen = now.agg(facts).first()[0]
        if seen == last:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def simhash_components(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP
) -> DataFrame:
    """doc_id, fp (long), component_id of ``docs`` (doc_id, text), one row per input row.

    Null and wordless texts have fingerprint zero and are linked like any other. Rows with a
    null doc_id get a row; a component of only such rows has a null id. Repeated rows repeat.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = in_arrow(pick(docs, "doc_id", "text"), _fingerprints(shingle), "doc_id long, fp long")
    rows = cut(rows, "fingerprints")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "fps")
    roots = components(link(fps.select("fp"), distance, group))
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    heads = linked.groupBy("root").agg(F.min("first_doc").alias("head"))
    named = linked.join(heads, "root").select("fp", "head")
    labels = cut(fps.join(named, "fp", "left").select("fp", "n", F.coalesce("head", "first_doc").alias("component_id")), "labels")
    # fingerprints of over a share of all rows, so at most HOT of them, go to all tasks; others meet by a shuffle
    often = max(fps.agg(F.sum("n")).first()[0] or 0, 1) // HOT + 1
    forget(fps)
    hot = F.broadcast(labels.where(F.col("n") > often).select("fp", F.col("component_id").alias("own"), F.lit(True).alias("hot")))
    marked = rows.join(hot, "fp", "left")
    direct = marked.where("hot").select("doc_id", "fp", F.col("own").alias("component_id"))
    rest = marked.where("hot is null").select("doc_id", "fp").join(labels.where(F.col("n") <= often), "fp")
    return direct.unionByName(rest.select("doc_id", "fp", "component_id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict = {}
