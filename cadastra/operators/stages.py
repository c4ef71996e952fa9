"""Stage borders: a table that is used several times is written once, so plans stay small."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def _local_dir() -> str:
    where = tempfile.mkdtemp(prefix="cadastra-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"file://{where}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` from the session's checkpoint folder (``spark.checkpoint.dir``), which executors share;
    only where none is set in a local run, in a temporary folder. Raises ValueError on a cluster without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and (not sc.master.startswith("local") or "cluster" in sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or _local_dir())
    return df.checkpoint()
