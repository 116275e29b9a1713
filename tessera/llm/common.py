"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Characters of text that are worked on at once, so that memory stays bounded
#: whatever the size of an Arrow batch.
SLICE_CHARS = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and sets a checkpoint folder if there is none.

    Texts are long, so Arrow batches get fewer rows than Spark's default, if
    that still holds.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        # Only where driver and tasks are one process does a local folder serve.
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; one longer text makes a range of its own."""
    import numpy as np

    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype="int64")
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    yield start, n


def tidy() -> None:
    """Gives freed memory back to the system; a worker lives on and would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def plain(texts: pa.Array) -> pa.Array:
    """Strings with nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores behind it as it takes to meet no column of these."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column in place of all that bear its name, whatever their case."""
    return df.select(*[named(c) for c in df.columns if c.lower() != name.lower()], value.alias(name))


def fold(key: str, parts: int) -> Column:
    """crc32 of a key's text modulo ``parts``; null keys are in no fold."""
    return F.crc32(named(key).cast("string").cast("binary")) % parts
