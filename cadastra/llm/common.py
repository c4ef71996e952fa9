"""Shared pieces of the corpus operators: word patterns, table cuts, schema guards."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import string
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What lies between words, which are runs of digits, lower-case a-z and everything beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in, which is the same there."""
    fixed = F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(fixed)


def words(col: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once. A plain column would be put into the
    body by the optimiser, and into a lambda that means once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(1)
def _local_dir() -> str:
    where = tempfile.mkdtemp(prefix="cadastra-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"file://{where}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where
    that is unset (tests, local mode) a temporary folder of this machine."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return _local_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


_written: list[str] = []


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


#: Keys of a few numbers, up to this many (some 100 MB in memory), go to all tasks for a join.
FEW = 500_000


def sent_if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A table of narrow rows that ``cut`` wrote, to be broadcast where its counted rows allow;
    else Spark joins it as it sees fit, by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def forget(df: DataFrame) -> None:
    """Delete what ``cut`` wrote; only for tables that no later plan reads."""
    _delete(df.sparkSession, df._cut_path)


def cut_alone(make, name: str) -> DataFrame:
    """``cut`` of the table that ``make()`` gives; what else was cut on its way is deleted."""
    before = set(_written)
    out = cut(make(), name)
    for path in [p for p in _written if p not in before and p != out._cut_path]:
        _delete(out.sparkSession, path)
    return out


def each(texts: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """A column's texts as UTF-8 bytes, null as empty, a few rows of Python objects at a time."""
    texts = texts.cast(pa.binary())
    for at in range(0, len(texts), rows):
        for t in texts.slice(at, rows).to_pylist():
            yield t or b""


def trim() -> None:
    """Return freed memory of a Python worker to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    """Return memory of a Python worker, which lives on for other tasks, to the system."""
    gc.collect()
    trim()


#: Rows that go to a Python worker at once: an executor holds each batch twice.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on batches of the session have at most ``ARROW_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in small batches, where each task gives its memory back at its end."""
    small_batches(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of a caller can't clash with ours."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*names)
