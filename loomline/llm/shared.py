"""Reading tables, the folder that the driver and all executors share, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.cut import shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df alone, so that further columns with clashing names can't get in the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def _give_back() -> None:
    """Returns to the system what this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sparing(run):
    """run, a function of Arrow batches, after whose last batch the worker gives its free memory back: workers live on and
    serve the next stages beside others of their executor."""

    @functools.wraps(run)
    def spared(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return spared


__all__ = ["only", "partitions", "shared_dir", "sparing", "table", "written"]
