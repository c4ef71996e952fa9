import random
import re

import pytest

from cadastra.llm.decontaminate import decontaminate


def brute(docs, items, span=13):
    """By definition, over all windows."""

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, x in items:
            v = words(x)
            size = min(len(v), span)
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids.add(str(item))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(3)
    voc = ["a", "b", "É", "x1"]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.choice([0, 1, 3, 5, 12, 13, 14, 20, 40])))) for i in range(12)]
    items += [(99, None), (98, "a " * 30), (97, "a b " * 20)]
    docs = [(i, " ".join(rnd.choice([*voc, "zz"]) for _ in range(rnd.randint(0, 60))) + f" {rnd.choice(items)[1]}") for i in range(40)]
    docs += [(100, None), (101, ""), (102, "a " * 300), (103, "q a b " * 100), (104, "A, b. " * 100), (102, "a " * 300), (105, "-")]
    return docs, items


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("which", ["all", "short", "long", "none"])
def test_equals_brute_force_broadcast_or_not(spark, docs, limit, which):
    rows, items = cases()
    items = {"all": items, "short": items[4:5], "long": [x for x in items if x[1] and len(x[1].split()) >= 13], "none": []}[which]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs(rows), bench, broadcast_windows=limit).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got], key=str) == brute(rows, items)


def test_empty_table_and_null_id(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    assert decontaminate(docs([]), bench).count() == 0
    got = decontaminate(docs([(None, "x one two three four five six seven eight nine ten eleven twelve thirteen")]), bench).collect()
    assert [(r.doc_id, r.n_hit, r.n_words) for r in got] == [(None, 13, 14)]


def test_long_text_with_one_passage(spark, docs):
    text = " ".join(f"w{i}" for i in range(20_000))
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(15_000, 15_020)))], "item_id long, text string")
    (r,) = decontaminate(docs([(1, text)]), bench).collect()
    assert (r.n_words, r.n_hit, r.item_ids) == (20_000, 20, ["7"])
