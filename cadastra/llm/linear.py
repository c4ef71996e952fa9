"""Hashed text features and logistic regression by follow-the-regularised-leader (FTRL-Proximal)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import each, give_back, pick, small_batches, trim

DIMENSIONS = 1 << 18
_MASK = np.uint64(DIMENSIONS - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
REMEMBERED = 150_000


class Features:
    """Distinct hashed features of a text: its tokens, pairs of neighbouring tokens, if asked
    for the tokens' beginnings, and the marks that ``marks`` gives for the text as a whole."""

    def __init__(self, pattern: bytes, lower: bool, prefixes: tuple[int, ...] = (), marks=None):
        self.find = re.compile(pattern).findall
        self.lower, self.prefixes, self.marks = lower, prefixes, marks
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 1 + len(self.prefixes)), np.uint64)

    def _learn(self, token: bytes) -> int:
        k = self.known[token] = len(self.known)
        if k >= len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[k, 0] = zlib.crc32(token)
        for j, n in enumerate(self.prefixes, 1):
            self.rows[k, j] = zlib.crc32(token[:n], 7919 * n) if len(token) > n else zlib.crc32(token)
        return k

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        tokens = self.find(text.lower() if self.lower else text)
        get, learn = self.known.get, self._learn
        ks = [k if (k := get(t)) is not None else learn(t) for t in tokens]
        rows = self.rows[np.array(ks, np.int64)]
        ids = rows[:, 0]
        pairs = ids[:-1] * _A + ids[1:] * _B
        parts = [rows.ravel() * _A >> np.uint64(40), pairs >> np.uint64(40)]
        if self.marks:
            marks = np.array([zlib.crc32(m) for m in self.marks(text, tokens)], np.uint64)
            parts.append(marks * _B >> np.uint64(40))
        return np.concatenate(parts) & _MASK


def distinct(features: np.ndarray) -> np.ndarray:
    return np.unique(features)


class Ftrl:
    """FTRL-Proximal over binary sparse features; the last weight is the bias, which isn't penalised."""

    def __init__(self, alpha: float = 0.2, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == DIMENSIONS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _step(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        new = n + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(n)) / self.alpha * w
        self.n[at] = new

    def learn(self, features: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(features, DIMENSIONS).astype(np.int64)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        self._step(at, w, np.full(len(at), weight * (p - label)))

    def level(self, a: np.ndarray, b: np.ndarray, weight: float) -> None:
        """One step against weight / 2 * (score(a) - score(b)) ** 2."""
        only_a, only_b = np.setdiff1d(a, b), np.setdiff1d(b, a)
        at = np.concatenate([only_a, only_b]).astype(np.int64)
        sign = np.concatenate([np.ones(len(only_a)), -np.ones(len(only_b))])
        w = self.weights(at)
        gap = float((w * sign).sum())
        if gap:
            self._step(at, w, weight * gap * sign)

    def model(self) -> np.ndarray:
        return self.weights(np.arange(DIMENSIONS + 1)).astype(np.float32)


def score(model: np.ndarray, features: np.ndarray) -> float:
    """Chance of label 1: the sparse dot product of distinct features and weights, and the bias."""
    hit = features[model[features.astype(np.int64)] != 0]
    margin = float(model[np.unique(hit).astype(np.int64)].sum()) + float(model[-1])
    return 1 / (1 + float(np.exp(-np.clip(margin, -35, 35))))


#: At most about this many labelled rows are learned from, chosen by a hash of doc_id.
SAMPLE = 8_000


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: those whose crc32 of doc_id leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Iterable[bytes], list[int]], np.ndarray], sample: int = SAMPLE) -> np.ndarray:
    """The model that ``train`` makes of the labelled texts in one task, on a bounded sample of
    the rows that aren't held out. Rows without doc_id or label are left out; of several labels
    of a document the larger counts; a table without labels gives a model of zeros."""
    known = pick(labels, "doc_id", label).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select(F.lit(0).alias("one"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("o"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), "y")

    def learn(group: pa.Table) -> pa.Table:
        # texts are taken one by one in order, so that there is one copy of them
        order = pc.sort_indices(group.select(["o", "text"]), [("o", "ascending"), ("text", "ascending")])
        texts, labels = group.column("text"), group.column("y")
        model = train((texts[i.as_py()].as_py() for i in order), [labels[i.as_py()].as_py() for i in order])
        out = pa.table({"model": pa.array([model.astype("<f4").tobytes()], pa.binary())})
        give_back()
        return out

    got = rows.groupBy("one").applyInArrow(learn, "model binary").collect()
    return np.frombuffer(got[0][0], "<f4") if got else np.zeros(DIMENSIONS + 1, np.float32)


def scorer(model: np.ndarray, make: Callable[[], Features]):
    """A column function from texts (as binary) to scores."""
    made: list[Features] = []

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(make())
        out = pa.array([score(model, made[0](t)) for t in each(texts)], pa.float64())
        trim()
        return out

    return lambda text: scores(F.coalesce(text, F.lit("")).cast("binary"))
