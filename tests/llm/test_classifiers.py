import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import quality, toxicity
from cadastra.llm.linear import DIMENSIONS, Ftrl, held_out, score
from cadastra.llm.quality import with_quality
from cadastra.llm.toxicity import counterfactuals, with_toxicity


def corpus(n=400):
    rnd = random.Random(5)
    words = ["river", "stone", "house", "field", "green", "slow", "walks", "under", "light", "morning"]
    rows, labels = [], []
    for i in range(n):
        ws = [rnd.choice(words) for _ in range(rnd.randint(20, 60))]
        low, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            ws[rnd.randrange(len(ws))] = rnd.choice(["moronic", "scumbag"])
        if low:
            ws = [w + "###" for w in ws]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


@pytest.mark.parametrize(("run", "label"), [(with_quality, "quality"), (with_toxicity, "toxic")])
def test_held_out_accuracy(spark, docs, run, label):
    rows, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = run(docs(rows), known).join(known, "doc_id").where(held_out(F.col("doc_id")))
    right = got.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col(label)).cast("double"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize(("run", "label"), [(with_quality, "quality"), (with_toxicity, "toxic")])
def test_any_row_gets_a_score(spark, docs, run, label):
    rows, labels = corpus(80)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    table = docs([*rows, (None, None), (900, ""), (901, "x " * 50_000), (900, "")])
    got = run(table, known)
    assert got.columns == table.columns  # its score replaces the input's
    assert got.where("score between 0 and 1").count() == 84
    assert run(docs([]), known).count() == 0
    assert {r.score for r in run(docs(rows[:3]), known.where("doc_id < 0")).collect()} == {0.5}


def test_group_terms_are_swapped():
    assert counterfactuals(b"The women and a gay man") == [b"the men and a lesbian girl", b"the girls and a straight boy"]
    assert counterfactuals(b"womenfolk mentor") == []


def test_neutral_mentions_of_a_group_stay_neutral(spark, docs):
    """A group term that stands mostly in toxic texts gets no weight of its own."""
    rnd = random.Random(7)
    words = ["river", "stone", "house", "field", "green", "slow", "walks", "under"]
    rows, labels = [], []
    for i in range(600):
        ws = [rnd.choice(words) for _ in range(20)]
        toxic = i % 3 == 0
        ws += (["scumbag", "muslims"] if i % 6 else ["scumbag"]) if toxic else (["muslims"] if i % 50 == 1 else [])
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    probes = [(9001, "the muslims walks under green field"), (9002, "the christians walks under green field"), (9003, "scumbag walks under green field")]
    got = {r.doc_id: r.score for r in with_toxicity(docs(rows + probes), known).where("doc_id > 9000").collect()}
    assert got[9001] < 0.5 and got[9003] > 0.7 and abs(got[9001] - got[9002]) < 0.3


def test_penalty_levels_scores_of_groups():
    """Off, the term that stands in toxic texts has a weight; on, swapped terms score alike."""
    rnd = random.Random(11)
    words = ["river", "stone", "house", "field", "green", "slow", "walks", "under"]
    texts, labels = [], []
    for i in range(600):
        ws = [rnd.choice(words) for _ in range(15)]
        toxic = i % 3 == 0
        ws += ["muslims"] * (toxic and i % 2 == 0) + ["scumbag"] * toxic
        texts.append(" ".join(ws).encode())
        labels.append(int(toxic))
    gap, toxic = {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        model, make = toxicity.train(texts, labels, penalty), toxicity.features()
        of = lambda t, model=model, make=make: score(model, make(t.encode()))
        gap[penalty] = abs(of("the muslims walks under green field") - of("the christians walks under green field"))
        toxic[penalty] = of("scumbag walks under")
    assert gap[0.0] > 3 * gap[toxicity.PENALTY] and gap[toxicity.PENALTY] < 0.05
    assert min(toxic.values()) > 0.7


class PlainFtrl:
    """FTRL-Proximal by its definition, a weight at a time."""

    def __init__(self, alpha, beta, l1, l2):
        self.alpha, self.beta, self.l1, self.l2, self.z, self.n = alpha, beta, l1, l2, {}, {}

    def weight(self, i):
        z, l1 = self.z.get(i, 0.0), 0.0 if i == DIMENSIONS else self.l1
        if abs(z) <= l1:
            return 0.0
        return -(z - math.copysign(l1, z)) / ((self.beta + math.sqrt(self.n.get(i, 0.0))) / self.alpha + self.l2)

    def step(self, grads):
        now = {i: self.weight(i) for i in grads}
        for i, g in grads.items():
            n = self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * now[i]
            self.n[i] = n + g * g

    def learn(self, xs, y, weight=1.0):
        at = [*xs, DIMENSIONS]
        p = 1 / (1 + math.exp(-sum(map(self.weight, at))))
        self.step({i: weight * (p - y) for i in at})

    def level(self, a, b, weight):
        gap = sum(map(self.weight, set(a) - set(b))) - sum(map(self.weight, set(b) - set(a)))
        if gap:
            self.step({i: weight * gap * (1 if i in a else -1) for i in set(a) ^ set(b)})


def test_ftrl_equals_its_definition():
    rnd = random.Random(3)
    args = {"alpha": 0.5, "beta": 1.0, "l1": 0.3, "l2": 0.1}
    fast, plain = Ftrl(**args), PlainFtrl(**args)
    rows = [(sorted(rnd.sample(range(40), rnd.randrange(1, 12))), rnd.randrange(2)) for _ in range(200)]
    for k, (xs, y) in enumerate(rows):
        fast.learn(np.array(xs), y, 1.0 + k % 2)
        plain.learn(xs, y, 1.0 + k % 2)
        if k % 5 == 0:
            other = rows[k - 1][0]
            fast.level(np.array(xs), np.array(other), 0.7)
            plain.level(xs, other, 0.7)
    assert np.allclose(fast.weights(np.arange(40)), [plain.weight(i) for i in range(40)], atol=1e-9)
    model = fast.model()
    for xs, _ in rows[:20]:
        by_hand = 1 / (1 + math.exp(-sum(plain.weight(i) for i in [*xs, DIMENSIONS])))
        assert score(model, np.array(xs + xs, np.uint64)) == pytest.approx(by_hand, abs=1e-5)


def plain_features(text, pattern, lower, prefixes, marks):
    """Hashed tokens, pairs, beginnings and marks, one by one in whole numbers."""
    cut = lambda x, by: ((x * by) % 2**64 >> 40) % DIMENSIONS
    a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    tokens = re.findall(pattern, text.lower() if lower else text)
    ids = [zlib.crc32(t) for t in tokens]
    out = {cut(i, a) for i in ids}
    out |= {cut(zlib.crc32(t[:n], 7919 * n) if len(t) > n else zlib.crc32(t), a) for t in tokens for n in prefixes}
    out |= {((x * a + y * b) % 2**64 >> 40) % DIMENSIONS for x, y in zip(ids, ids[1:])}
    return out | {cut(zlib.crc32(m), b) for m in (marks(text, tokens) if marks else [])}


@pytest.mark.parametrize("text", [b"", b"One two, two THREE\n\xc3\xa9t\xc3\xa9 beginnings!!", b"a a a a b"])
def test_features_equal_plain_hashing(text):
    got = set(np.unique(quality.features()(text)).tolist())
    assert got == plain_features(text, rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+", False, (), quality.marks)
    assert set(np.unique(toxicity.features()(text)).tolist()) == plain_features(text, rb"[a-z\x80-\xff]+", True, (4, 5, 6), None)
