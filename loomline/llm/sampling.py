"""Bounded samples of labelled rows, the only place where an operator learns from fewer rows than there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str = "doc_id") -> Column:
    """0 to 4: crc32 of doc_id as text, modulo 5. Fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 5


def sample_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most so many distinct doc_id of ids, in the order of their hashes: a sample that depends on ids alone.

    The limit bounds it, so it may be broadcast.
    """
    return ids.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
