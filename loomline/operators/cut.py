"""Cutting lineage: intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one of a local session. Executors of
    a cluster could not see that, so there it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="loomline-", ignore_cleanup_errors=True))
        atexit.register(_own[0].cleanup)
    return f"file://{_own[0].name}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of the shared folder: computed once, and safe against lost executors and repeated tasks."""
    path = f"{shared_dir(df.sparkSession)}/loomline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it has fewer partitions than there are cores: a small file is one, and what follows would run
    on one core. Tables of many partitions stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
