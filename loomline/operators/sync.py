"""What a reader needs to follow a text while it is spoken: master texts of chapters, files of matches, images and visual
elements between beats, match rates, and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.alignment import match_histogram
from loomline.operators.timeline import INTER_CHAPTER, INTER_SCENE, INTRA

PREVIEW = 120  # fixed: characters of an unmatched beat that are reported


def master_shadow(nodes: DataFrame) -> DataFrame:
    """nodes (chapter_id, part_no, node_no, s, e, ...) of a chapter's parts with s and e counted through the chapter: each
    part begins where the one before ends, a space after it (as each text node has one)."""
    ends = nodes.groupBy("chapter_id", "part_no").agg((F.max("e") + 1).alias("__size"))
    before = Window.partitionBy("chapter_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("__base", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    return nodes.join(base, ["chapter_id", "part_no"]).withColumn("s", F.col("s") + F.col("__base")).withColumn("e", F.col("e") + F.col("__base")).drop("__base")


def containing(matches: DataFrame, segments: DataFrame, key: str = "chapter_id", value: str = "xhtml") -> DataFrame:
    """matches (key, beat_id, s, e) with the value of the segment (key, s, e, value) in which each begins; empty where
    there is none. Segments don't overlap, so the last one that begins by then is looked at: one sort of both."""
    rows = matches.select(key, "beat_id", F.col("s").alias("x"), F.lit(1).alias("rank"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("string").alias("v"))
    rows = rows.unionByName(segments.where("e > s").select(key, F.lit(None).cast(matches.schema["beat_id"].dataType).alias("beat_id"), F.col("s").alias("x"), F.lit(0).alias("rank"), F.col("e").cast("long").alias("to"), F.col(value).cast("string").alias("v")))
    order = Window.partitionBy(key).orderBy("x", "rank").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("rank") == 0, F.struct("to", "v")), True).over(order)
    found = rows.withColumn("seg", held).where("rank = 1")
    return found.select(key, "beat_id", F.when(F.col("seg.to") > F.col("x"), F.col("seg.v")).otherwise("").alias(value))


def brackets(beats: DataFrame, key: str = "chapter_id") -> DataFrame:
    """beats (key, pos, s, e; null where unmatched) with before_end and after_start: the end of the last matched beat
    before each, else 0, and the start of the first one after it, else null."""
    order = Window.partitionBy(key).orderBy("pos")
    before = F.last("e", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("s", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return beats.withColumn("before_end", F.coalesce(before, F.lit(0)).cast("long")).withColumn("after_start", after)


def first_and_last(beats: DataFrame, key: str = "xhtml") -> DataFrame:
    """(key, first_beat, last_beat) of matched beats (key, pos, beat_id) in playback order; those of no file don't count."""
    return beats.where(F.col(key) != "").groupBy(key).agg(F.min_by("beat_id", "pos").alias("first_beat"), F.max_by("beat_id", "pos").alias("last_beat"))


def image_pages(spine: DataFrame, texts: DataFrame) -> DataFrame:
    """(book_id, spine_idx, after_beat, before_beat) of spine's pages (book_id, spine_idx, xhtml, images) with images and
    no text of their own: the last beat of the nearest text before each, and the first of the nearest one after it.
    texts: (xhtml, first_beat, last_beat)."""
    held = spine.join(texts, "xhtml", "left")
    order = Window.partitionBy("book_id").orderBy("spine_idx")
    after = F.last("last_beat", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.first("first_beat", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    placed = held.withColumns({"after_beat": after, "before_beat": before})
    return placed.where("images > 0 and first_beat is null").select("book_id", "spine_idx", "xhtml", "after_beat", "before_beat")


def triggered(marks: DataFrame, timings: DataFrame) -> DataFrame:
    """marks (..., before_beat) with trigger_ms: when the next beat (timings: beat_id, start_ms) begins; null without one."""
    return marks.join(timings.select(F.col("beat_id").alias("before_beat"), F.col("start_ms").alias("trigger_ms")), "before_beat", "left")


def visual_elements(images: DataFrame, elements: DataFrame) -> DataFrame:
    """Images found in the text and elements recorded at ingest, as one table; images have the kind image where they have
    none. Columns that only one side has are null on the other."""
    named = images.withColumn("kind", F.coalesce("kind", F.lit("image"))) if "kind" in images.columns else images.withColumn("kind", F.lit("image"))
    return named.unionByName(elements, allowMissingColumns=True)


def match_rates(beats: DataFrame, key: str = "chapter_id") -> DataFrame:
    """(key, total, matched, percent) of beats (key, confidence); percent to a tenth, half up."""
    hit = F.count_if(F.col("confidence") != "none")
    out = beats.groupBy(key).agg(F.count("*").alias("total"), hit.alias("matched"))
    # whole numbers, so that the rounding doesn't depend on the engine
    return out.withColumn("percent", (F.expr("(2000 * matched + total) div (2 * total)") / 10).cast("double"))


def unmatched(beats: DataFrame) -> DataFrame:
    """(chapter_id, beat_id, text_preview, reason) of beats (chapter_id, beat_id, text, confidence) that stand nowhere."""
    reason = F.when(F.coalesce(F.col("has_source"), F.lit(True)), "no anchor in chapter source").otherwise("no source for chapter") if "has_source" in beats.columns else F.lit("no anchor in chapter source")
    return beats.where("confidence = 'none'").select("chapter_id", "beat_id", F.left("text", F.lit(PREVIEW)).alias("text_preview"), reason.alias("reason"))


def manifest(book_id: str, beats: DataFrame, images: DataFrame, elements: DataFrame) -> DataFrame:
    """One row of JSON: counts, confidences, pauses, and then one row for each matched beat, image and visual element in
    order, so that no row holds a book: (section, n, item).

    beats: chapter_id, pos, beat_id, xhtml, type, speaker, start_ms, end_ms, confidence ("none" where unmatched)."""
    hit = F.col("confidence") != "none"
    counts = beats.agg(F.count("*").alias("total_beats"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"))
    seen = match_histogram(beats).where("confidence <> 'none'").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("confidence", "n")))).alias("match_confidence"))
    pauses = F.struct(F.lit(INTRA).alias("intra_ms"), F.lit(INTER_SCENE).alias("inter_scene_ms"), F.lit(INTER_CHAPTER).alias("inter_chapter_ms"))
    head = counts.join(F.broadcast(seen), F.lit(True))
    head = head.select(F.lit("head").alias("section"), F.lit(0).cast("long").alias("n"), F.to_json(F.struct(F.lit(book_id).alias("book_id"), "total_beats", "matched", "unmatched", "match_confidence", pauses.alias("silences"))).alias("item"))

    def items(df: DataFrame, section: str, key: str, order: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
        return df.select(F.lit(section).alias("section"), rank.alias("n"), F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "pos"])).alias("item"))

    out = head.unionByName(items(beats.where(hit).withColumnRenamed("confidence", "match_confidence"), "beat", "chapter_id", ["pos"]))
    for df, section in ((images, "image"), (elements, "visual_element")):
        out = out.unionByName(items(df, section, "chapter_id", [c for c in df.columns if c != "chapter_id"]))
    return out
