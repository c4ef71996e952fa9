import random

import numpy as np
import pytest
import xxhash

from cadastra.llm.simhash import allocate, components, expected_candidates, fingerprint, link, partitions, simhash_components


def by_definition(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, distance):
    """Smallest index reachable among 64-bit numbers, over all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", None, "a", "A b", "a b c", "a b c d", "ÄÖ x\ty\nz \x0b q", "a " * 500])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == by_definition(text)


@pytest.mark.parametrize(("distance", "group"), [(2, 64), (2, 2), (3, 2), (4, 64), (4, 3)])
def test_links_equal_brute_force(spark, distance, group):
    rnd = random.Random(distance)
    values = [rnd.getrandbits(64) for _ in range(60)]
    for v in values[:20]:  # chains and a crowd around one value
        for _ in range(3):
            v ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            values.append(v)
    values += [values[0] ^ (1 << i) for i in range(40)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(link(fps, distance, group)).collect()}
    mine = [roots.get(x, x) for x in signed]
    wanted = classes(values, distance)
    assert len(set(zip(mine, wanted))) == len(set(wanted)) == len(set(mine))


def test_components_are_smallest_reachable(spark, docs):
    rows = [(5, "one two three four five six seven"), (3, "one two three four five six seven"), (9, "quite another text of some words here"), (1, None), (2, ""), (2, ""), (None, "one two three four five six seven")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(docs(rows)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 9), (1, 1), (2, 1), (2, 1)], key=str)
    assert simhash_components(docs([])).count() == 0


def test_thresholds_follow_the_generalised_pigeonhole():
    rnd = np.random.default_rng(1)
    bits = rnd.random((500, 64)) < np.linspace(0.05, 0.95, 64)
    sums = bits.T.astype(float) @ bits
    for m in (2, 3, 4):
        parts = partitions(500, sums, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        cost, ts = allocate([expected_candidates(500, sums, p, 4) for p in parts], 4)
        assert sum(ts) == 4 - m + 1 and min(ts) >= -1 and cost > 0
