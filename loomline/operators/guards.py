"""Checks that stop a run, or name what has to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degenerate_chapters(chapters: DataFrame, scenes: DataFrame, beats: DataFrame) -> DataFrame:
    """(chapter_id) of chapters (chapter_id) whose result is no good: no scenes (chapter_id, scene_id), or one of them
    without beats (chapter_id, scene_id)."""
    full = beats.groupBy("chapter_id", "scene_id").agg(F.count("*").alias("n"))
    held = scenes.select("chapter_id", "scene_id").distinct().join(full, ["chapter_id", "scene_id"], "left")
    least = held.groupBy("chapter_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"))
    return chapters.select("chapter_id").distinct().join(least, "chapter_id", "left").where("coalesce(least, 0) = 0").select("chapter_id")


def with_beats(scenes: DataFrame, beats: str = "n_beats") -> DataFrame:
    """scenes as they are; one without beats is an error when it is read."""
    wrong = F.raise_error(F.concat(F.lit("no beats in scene "), F.col("scene_id").cast("string"))).cast(scenes.schema[beats].dataType)
    return scenes.withColumn(beats, F.when(F.col(beats) > 0, F.col(beats)).otherwise(wrong))


def count_mismatches(left: DataFrame, right: DataFrame, key: str = "chapter_id") -> DataFrame:
    """(key, n_left, n_right) of the keys whose rows differ in number, keys that only one side has included."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full_outer").select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_left", "n_right")])
    return both.where("n_left <> n_right")


def missing(needed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """The keys of needed that aren't there, once each."""
    return needed.select(key).distinct().join(there.select(key), key, "left_anti")


def demotions(items: DataFrame) -> DataFrame:
    """(chunk_id, demoted) of checked items (chunk_id, type, was): how many dialogue lines became staging."""
    return items.groupBy("chunk_id").agg(F.count_if((F.col("was") == "dialogue") & (F.col("type") == "staging")).alias("demoted"))
