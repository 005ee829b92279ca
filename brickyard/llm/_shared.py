"""The folder that driver and executors share."""

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset, and the master is local, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = f"file://{tempfile.mkdtemp(prefix='brickyard-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def unused(name: str, columns: list[str]) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def named(column: str) -> Column:
    """The column of this name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder, so lost executors cost no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Has the files of shuffles that nothing refers to any more removed now: Spark does so after the driver's own collections, which are rare on a large heap. Python's own references to plans go first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in small Arrow batches, so a worker's memory follows the texts, not the row count.

    A session that has limits of its own keeps them.
    """
    own = spark.conf.getAll
    for name, value in _BATCHES.items():
        if name not in own:
            spark.conf.set(name, value)


def release() -> None:
    """Gives a worker's freed memory back to the system: idle workers are kept, and theirs would stay taken."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
