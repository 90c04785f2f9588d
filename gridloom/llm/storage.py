"""Lineage cuts in the folder that all executors share, bounded batches, and names that don't clash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame

#: Rows go to Python workers in batches of about so many bytes (or one row).
BATCH_BYTES = 4 << 20


def _folder(df: DataFrame) -> str:
    """spark.checkpoint.dir; a local folder only in local mode (as in tests), where driver and executors are one machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master.startswith("local[") or context.master == "local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the same folder, read again."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose batches for Python workers are bounded by bytes as well as by rows."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    known = conf.get(name, None)
    if known is None or not known.isdigit() or int(known) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """The wanted column name, with as many underscores as it takes to be new (case aside)."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
