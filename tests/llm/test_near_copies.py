import random

import pytest

import corpus_pipeline
from cadastra.llm.near_copies import near_components


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components_by_pairs(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def planted(seed=3):
    """Texts with copies of one to many changed words: pairs, chains and a crowd around one text."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rnd.choice((1, 3, 5, 6, 9, 40, 120)))) for _ in range(60)] + [None, "", " "]

    def change(text, n):
        ws = text.split()
        for _ in range(n):
            ws[rnd.randrange(len(ws))] = word()
        return " ".join(ws)

    for t in [t for t in texts if t and len(t.split()) >= 40][:20]:
        texts += [change(t, n) for n in (1, 2, 3, 4)]
        for _ in range(4):
            t = change(t, 2)
            texts.append(t)
    crowd = " ".join(word() for _ in range(120))
    texts += [change(crowd, rnd.randrange(1, 9)) for _ in range(150)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("share", [1, 4])
def test_components_equal_brute_force(spark, docs, share):
    texts = planted()
    got = {r.doc_id: r.component_id for r in near_components(docs(list(enumerate(texts))), share).collect()}
    wanted = components_by_pairs(texts)
    assert [got[i] for i in range(len(texts))] == wanted
    assert 1 < len(set(wanted)) < len(texts)


def test_stage_drops_copies_at_similarity_08(spark, docs):
    texts = planted(4)
    left = corpus_pipeline.near_dedup_stage(spark, docs(list(enumerate(texts))), "").collect()
    assert sorted(r.doc_id for r in left) == sorted(set(components_by_pairs(texts)))


def test_empty_table(docs):
    assert near_components(docs([])).count() == 0
