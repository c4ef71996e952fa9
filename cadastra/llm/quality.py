"""Quality classifier: hashed word n-grams, FTRL logistic regression, sparse dot products.

Tokens are runs of letters and digits and runs of other signs, as they are written; features
are single tokens, pairs, and marks of the whole text (length, repetition, capitals).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import table
from cadastra.llm.linear import SAMPLE, Features, Ftrl, distinct, fit, held_out, scorer

EPOCHS = 4
#: Weight of rows of label 0, the rarer.
LOW_WEIGHT = 2.0


def marks(text: bytes, tokens: list[bytes]) -> list[bytes]:
    n = len(tokens)
    out = [b"#length %d" % n.bit_length()]
    if n:
        lines = text.split(b"\n")
        same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        out += [
            b"#distinct %d" % (10 * len(set(tokens)) // n),
            b"#capitals %d" % (10 * sum(map(bytes.isupper, tokens)) // n),
            b"#repeated %d" % min(10, 20 * same // n),
            b"#width %d" % min(len(text) // n, 40),
            b"#lines %d" % (10 * len(set(lines)) // len(lines)),
        ]
    return out


def features() -> Features:
    return Features(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+", False, marks=marks)


def train(texts: Iterable[bytes], labels: list[int]) -> np.ndarray:
    make, model = features(), Ftrl(alpha=0.5, l1=3.0, l2=0.1)
    rows = [distinct(make(t)).astype(np.int32) for t in texts]
    for _ in range(EPOCHS):
        for x, y in zip(rows, labels, strict=True):
            model.learn(x, int(y), 1.0 if y else LOW_WEIGHT)
    return model.model()


def with_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1, higher: better), learned from labels.quality.

    Every row keeps its columns and gets a score, null and empty texts too; only the text is an
    input of it. Repeated rows score alike. Without any usable label all scores are 0.5. A
    column ``score`` of the input is replaced.
    """
    model = fit(docs, labels, "quality", train, sample)
    return docs.withColumn("score", scorer(model, features)(F.col("text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = with_quality(docs, table(spark, sf_dir, "labels"))
    return got.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict = {}
