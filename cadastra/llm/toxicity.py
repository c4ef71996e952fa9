"""Toxicity classifier with counterfactual regularisation.

An FTRL logistic regression over words, word pairs and word beginnings. For every labelled
text that names a group of people, the group terms are swapped for others of their kind, and
the squared change of the score is a penalty: a neutral mention of a group then can't
carry weight by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import table
from cadastra.llm.linear import SAMPLE, Features, Ftrl, distinct, fit, held_out, scorer

#: Terms that name groups, by kind; a swap stays within its kind.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "transgender people"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["black", "white", "asian", "african", "latino", "arab", "indigenous"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "migrants", "natives"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs"],
]
EPOCHS = 6
TOXIC_WEIGHT = 5.0
#: Weight of the penalty on score changes.
PENALTY = 1.0


def _swaps() -> tuple[re.Pattern, list[dict[bytes, bytes]]]:
    terms: list[dict[bytes, bytes]] = [{}, {}]
    for kind in IDENTITY_TERMS:
        for i, t in enumerate(kind):
            for shift, into in enumerate(terms, 1):
                into[t.encode()] = kind[(i + shift) % len(kind)].encode()
    every = sorted(terms[0], key=lambda t: (-len(t), t))
    return re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(map(re.escape, every)) + rb")(?![a-z\x80-\xff])"), terms


def counterfactuals(text: bytes) -> list[bytes]:
    """The text with every group term swapped for another, in two ways; none without terms."""
    found, terms = _SWAPS
    low = text.lower()
    if not found.search(low):
        return []
    return [found.sub(lambda m, t=t: t[m[0]], low) for t in terms]


_SWAPS = _swaps()


def features() -> Features:
    return Features(rb"[a-z\x80-\xff]+", True, prefixes=(4, 5, 6))


def train(texts: Iterable[bytes], labels: list[int], penalty: float = PENALTY) -> np.ndarray:
    """The model; without a penalty swapped texts are not looked at."""
    make, model = features(), Ftrl(alpha=1.0, l1=8.0, l2=0.1)
    of = lambda t: distinct(make(t)).astype(np.int32)
    rows = [(of(t), [of(c) for c in counterfactuals(t)] if penalty else []) for t in texts]
    for _ in range(EPOCHS):
        for (x, cs), y in zip(rows, labels, strict=True):
            model.learn(x, int(y), TOXIC_WEIGHT if y else 1.0)
            for c in cs:
                model.learn(c, int(y), (TOXIC_WEIGHT if y else 1.0) / 2)
                model.level(x, c, penalty)
    return model.model()


def with_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1, higher: more toxic), learned from labels.toxic.

    Every row keeps its columns and gets a score, null and empty texts too; only the text is an
    input of it. Repeated rows score alike. Without any usable label all scores are 0.5. A
    column ``score`` of the input is replaced.
    """
    model = fit(docs, labels, "toxic", train, sample)
    return docs.withColumn("score", scorer(model, features)(F.col("text")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = with_toxicity(docs, table(spark, sf_dir, "labels"))
    return got.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict = {}
