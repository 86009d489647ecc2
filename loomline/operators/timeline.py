"""Timelines of beats in whole milliseconds: gaps, offsets, mix plans, sync entries, and what plays at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.numbers import srt_time

INTRA, INTER_SCENE, INTER_CHAPTER = 250, 1000, 2000  # fixed: default pads
LEAD_IN, SCENARIO_INTER_SCENE, SHORTEST_CUE = 350, 750, 1500  # fixed: of a scenario


def beat_timeline(beats: DataFrame, intra: int = INTRA, inter_scene: int = INTER_SCENE, inter_chapter: int = INTER_CHAPTER) -> DataFrame:
    """beats (chapter_id, scene_id, pos, duration_ms) with start_ms and end_ms. Within a chapter, the gap before a beat
    depends on whether its scene is new; the chapters of a book follow one another in order of their ids after a pause. A
    book is a value of book_id; without that column all chapters are one book's."""
    keys = ["book_id", "chapter_id"] if "book_id" in beats.columns else ["chapter_id"]
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.lag("scene_id").over(order)
    gap = F.when(before.isNull(), 0).when(before == F.col("scene_id"), intra).otherwise(inter_scene)
    local = beats.withColumn("gap", gap.cast("long"))
    local = local.withColumn("end_ms", F.sum(F.col("gap") + F.col("duration_ms")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    offsets = chapter_offsets(local.groupBy(*keys).agg(F.max("end_ms").alias("total_ms")), inter_chapter)
    placed = local.join(offsets.select(*keys, "offset_ms"), keys)
    placed = placed.withColumn("end_ms", F.col("end_ms") + F.col("offset_ms"))
    return placed.withColumn("start_ms", F.col("end_ms") - F.col("duration_ms")).drop("gap", "offset_ms")


def chapter_offsets(totals: DataFrame, inter_chapter: int = INTER_CHAPTER) -> DataFrame:
    """totals (chapter_id, total_ms) with offset_ms, a pause after every chapter but the last. The order is over the
    chapters of a book (book_id; without that column, of the one book that there is), one row each."""
    book = ["book_id"] if "book_id" in totals.columns else [F.lit(0)]
    before = Window.partitionBy(*book).orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("offset_ms", F.coalesce(F.sum(F.col("total_ms") + inter_chapter).over(before), F.lit(0)).cast("long"))


def mix_plan(beats: DataFrame, intra: int = INTRA, inter_scene: int = INTER_SCENE, lead_in: int = LEAD_IN) -> DataFrame:
    """The items of a chapter's mix in order: a pad before each beat but the first, its lead-in, and the beat."""
    order = Window.partitionBy("chapter_id").orderBy("pos")
    beats = beats.withColumn("__before", F.lag("scene_id").over(order))
    before = F.col("__before")
    pad = F.when(before == F.col("scene_id"), intra).otherwise(inter_scene)

    def item(kind, rank, length):
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), length.cast("long").alias("length_ms"))

    lead = F.array(item("lead", 1, F.lit(lead_in)), item("beat", 2, F.col("duration_ms"))) if lead_in else F.array(item("beat", 2, F.col("duration_ms")))
    items = F.when(before.isNull(), lead).otherwise(F.concat(F.array(item("pad", 0, pad)), lead))
    out = beats.withColumn("item", F.explode(items)).select("chapter_id", "pos", "item.rank", "item.kind", "item.length_ms")
    return out.withColumn("item_no", F.row_number().over(Window.partitionBy("chapter_id").orderBy("pos", "rank"))).drop("rank")


def line_times(beats: DataFrame, intra: int = INTRA, inter_group: int = SCENARIO_INTER_SCENE, lead_in: int = LEAD_IN) -> DataFrame:
    """(scene_id, line_no, start_ms, end_ms) of dialogue lines from their rendered chunks (scene_id, pos, group_id,
    line_no, duration_ms): the lead-in counts to the line that it opens."""
    order = Window.partitionBy("scene_id").orderBy("pos")
    before = F.lag("group_id").over(order)
    gap = F.when(before.isNull(), 0).when(before == F.col("group_id"), intra).otherwise(inter_group)
    timed = beats.withColumn("whole", F.col("duration_ms") + lead_in)
    timed = timed.withColumn("gap", gap).withColumn("end_ms", F.sum(F.col("gap") + F.col("whole")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    timed = timed.withColumn("start_ms", F.col("end_ms") - F.col("whole"))
    return timed.groupBy("scene_id", "line_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def sync_entries(items: DataFrame, lines: DataFrame, offset: str | None = None) -> DataFrame:
    """items (scene_id, item_no, type, text) with start_ms and end_ms: dialogue has its line's span, staging what lies
    between the speech before and the next (or the scene's end), a cue no width at the end of the speech before."""
    order = Window.partitionBy("scene_id").orderBy("item_no")
    counted = items.withColumn("line_no", F.sum(F.when(F.col("type") == "dialogue", 1).otherwise(0)).over(order).cast("int"))
    spoken = counted.join(lines.select("scene_id", "line_no", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")), ["scene_id", "line_no"], "left")
    talk = F.col("type") == "dialogue"
    past, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    # the end of the scene's last line stands in for the scene's
    scene_end = F.coalesce(F.max("e").over(Window.partitionBy("scene_id")), F.lit(0))
    held = spoken.withColumn("before", F.coalesce(F.last(F.when(talk, F.col("e")), True).over(past), F.lit(0)))
    held = held.withColumn("after", F.coalesce(F.first(F.when(talk, F.col("s")), True).over(ahead), scene_end))
    start = F.when(talk, F.coalesce("s", "before")).otherwise(F.col("before"))
    end = F.when(talk, F.coalesce("e", "before")).when(F.col("type") == "staging", F.greatest("before", "after")).otherwise(F.col("before"))
    return held.select("scene_id", "item_no", "type", "text", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))


def play_offsets(scenes: DataFrame, inter_scene: int = INTER_SCENE) -> DataFrame:
    """scenes (play_id, scene_no, length_ms) with offset_ms."""
    before = Window.partitionBy("play_id").orderBy("scene_no").rowsBetween(Window.unboundedPreceding, -1)
    return scenes.withColumn("offset_ms", F.coalesce(F.sum(F.col("length_ms") + inter_scene).over(before), F.lit(0)).cast("long"))


def srt_blocks(entries: DataFrame, key: str = "scene_id") -> DataFrame:
    """(key, n, block) of entries (key, item_no, type, text, start_ms, end_ms): what has no width shows for a while."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "item_no"))
    shown = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + SHORTEST_CUE).otherwise(F.col("end_ms"))
    payload = F.when(F.col("type") == "dialogue", F.col("text")).when(F.col("type") == "staging", F.concat(F.lit("["), F.col("text"), F.lit("]"))).otherwise(F.concat(F.lit("♪ "), F.col("text")))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(shown), F.lit("\n"), payload)
    return entries.withColumn("n", number).select(key, F.col("n").cast("long").alias("n"), block.alias("block"))


def active_beats(points: DataFrame, beats: DataFrame, key: str, bucket_ms: int = 10_000) -> DataFrame:
    """points (key, t) with every beat (key, pos, start_ms, end_ms) that plays at t: start <= t < end.

    Beats are dealt to the time buckets that they touch, so the join is an equality on key and bucket."""
    held = beats.where("end_ms > start_ms").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))))
    asked = points.withColumn("bucket", F.floor(F.col("t") / bucket_ms))
    return asked.join(held, [key, "bucket"]).where("start_ms <= t and t < end_ms").drop("bucket")


def nearest_beats(marks: DataFrame, beats: DataFrame, key: str) -> DataFrame:
    """marks (key, mark_no, at) with after_pos, the last beat that ends by then, and before_pos, the first that starts
    from then on. beats: (key, pos, s, e), both rising. As-of in both directions: one sort of marks and beats together."""
    # at equal places, ends stand before marks, and marks before starts
    rows = marks.select(key, F.col("at").alias("x"), F.lit(1).alias("rank"), F.col("mark_no"), F.lit(None).cast("long").alias("pos"))
    rows = rows.unionByName(beats.select(key, F.col("e").alias("x"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("mark_no"), F.col("pos").cast("long")))
    rows = rows.unionByName(beats.select(key, F.col("s").alias("x"), F.lit(2).alias("rank"), F.lit(None).cast("long").alias("mark_no"), F.col("pos").cast("long")))
    order = Window.partitionBy(key).orderBy("x", "rank", "pos", "mark_no")
    rows = rows.withColumn("after_pos", F.last(F.when(F.col("rank") == 0, F.col("pos")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before_pos", F.first(F.when(F.col("rank") == 2, F.col("pos")), True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return rows.where("rank = 1").select(key, "mark_no", F.col("x").alias("at"), "after_pos", "before_pos")


def visual_placement(elements: DataFrame, beats: DataFrame, key: str) -> DataFrame:
    """elements (key, element_no, after_paragraph) with the last beat up to that paragraph in playback order, the first one
    after it, and when the element shows: at the start of the next beat, else the end of the one before; at 0 before any.

    Beats (key, pos, source_paragraph, start_ms, end_ms) and elements meet in one sort by paragraph, in which the last beat
    so far is a running maximum of positions, and the first one to come a running minimum from the other end."""
    beat = F.struct(F.col("pos").cast("long").alias("pos"), "start_ms", "end_ms")
    rows = beats.select(key, F.col("source_paragraph").cast("long").alias("x"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("element_no"), beat.alias("beat"))
    none = F.lit(None).cast(rows.schema["beat"].dataType)
    rows = rows.unionByName(elements.select(key, F.col("after_paragraph").cast("long").alias("x"), F.lit(1).alias("rank"), F.col("element_no").cast("long").alias("element_no"), none.alias("beat")))
    order = Window.partitionBy(key).orderBy("x", "rank")
    placed = rows.withColumns({"upto": F.max("beat").over(order.rowsBetween(Window.unboundedPreceding, -1)), "later": F.min("beat").over(order.rowsBetween(1, Window.unboundedFollowing))})
    trigger = F.when(F.col("upto").isNull(), 0).otherwise(F.coalesce("later.start_ms", "upto.end_ms")).cast("long")
    return placed.where("rank = 1").select(key, "element_no", F.col("x").alias("after_paragraph"), F.col("upto.pos").alias("after_pos"), F.col("later.pos").alias("before_pos"), trigger.alias("trigger_ms"))
