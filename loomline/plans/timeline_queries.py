"""Queries on timelines. Books are twenty chapters each, chapters ten conversations, scenes conversations, beats their turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import ms
from loomline.operators import timeline
from loomline.plans.registry import query, table
from loomline.plans.text_queries import ITEMS, script_items

BEATS = """SELECT conv_id // 200 AS book_id, conv_id // 10 AS chapter_id, conv_id AS scene_id, conv_id * 10000 + turn AS pos, role, text, CAST((length(text) * 1000) // 12 AS BIGINT) AS duration_ms FROM conversations"""
TIMELINE = f"""
    b AS ({BEATS}),
    g AS (SELECT *, CASE WHEN lag(scene_id) OVER w IS NULL THEN 0 WHEN lag(scene_id) OVER w = scene_id THEN 250 ELSE 1000 END AS gap FROM b WINDOW w AS (PARTITION BY chapter_id ORDER BY pos)),
    l AS (SELECT *, sum(gap + duration_ms) OVER (PARTITION BY chapter_id ORDER BY pos) AS e FROM g),
    o AS (SELECT chapter_id, coalesce(sum(t + 2000) OVER (PARTITION BY book_id ORDER BY chapter_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT book_id, chapter_id, max(e) AS t FROM l GROUP BY book_id, chapter_id)),
    timeline AS (SELECT book_id, chapter_id, scene_id, pos, role, text, duration_ms, CAST(e + o - duration_ms AS BIGINT) AS start_ms, CAST(e + o AS BIGINT) AS end_ms FROM l JOIN o USING (chapter_id))"""


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.floor(F.col("conv_id") / 200).alias("book_id"), F.floor(F.col("conv_id") / 10).alias("chapter_id"), F.col("conv_id").alias("scene_id"), (F.col("conv_id") * 10000 + F.col("turn")).alias("pos"), "role", "text", ms(F.col("text")).alias("duration_ms"))


@query(f"WITH {TIMELINE} SELECT chapter_id, scene_id, pos, start_ms, end_ms FROM timeline")
def timeline_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.beat_timeline(beats(spark, sf_dir)).select("chapter_id", "scene_id", "pos", "start_ms", "end_ms")


@query(f"""
    WITH b AS ({BEATS})
    SELECT chapter_id, CAST(count(DISTINCT scene_id) AS BIGINT) AS scenes, CAST(count(*) FILTER (role = 'system') AS BIGINT) AS narration, CAST(count(*) FILTER (role <> 'system') AS BIGINT) AS dialogue,
           CAST(sum(duration_ms) AS BIGINT) AS total_ms, (SELECT string_agg(DISTINCT role, ',' ORDER BY role) FROM b x WHERE x.chapter_id = b.chapter_id AND role <> 'system') AS speakers
    FROM b GROUP BY chapter_id""")
def chapter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = F.col("role") != "system"
    return beats(spark, sf_dir).groupBy("chapter_id").agg(
        F.count_distinct("scene_id").alias("scenes"), F.count_if(~talk).alias("narration"), F.count_if(talk).alias("dialogue"), F.sum("duration_ms").alias("total_ms"),
        F.array_join(F.array_sort(F.collect_set(F.when(talk, F.col("role")))), ",").alias("speakers"),
    )


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 100")
def beat_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred beats of the book; here the limit is the feature."""
    from loomline.operators.rendering import first_beats

    return first_beats(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 100, "conv_id", "turn")


@query(f"""
    WITH b AS ({BEATS})
    SELECT chapter_id, pos, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY pos) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_id, pos) AS BIGINT) AS position FROM b""")
def book_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.operators.rendering import global_positions

    out = global_positions(beats(spark, sf_dir), "pos")
    n = F.row_number().over(Window.partitionBy("chapter_id").orderBy("pos"))
    return out.select("chapter_id", "pos", n.cast("long").alias("n"), "position")


@query(f"""
    WITH b AS ({BEATS}),
    g AS (SELECT *, lag(scene_id) OVER (PARTITION BY chapter_id ORDER BY pos) AS before FROM b),
    i AS (SELECT chapter_id, pos, 0 AS rank, 'pad' AS kind, CASE WHEN before = scene_id THEN 250 ELSE 1000 END AS length_ms FROM g WHERE before IS NOT NULL
          UNION ALL SELECT chapter_id, pos, 1, 'lead', 350 FROM g UNION ALL SELECT chapter_id, pos, 2, 'beat', duration_ms FROM g)
    SELECT chapter_id, pos, kind, CAST(length_ms AS BIGINT) AS length_ms, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY pos, rank) AS BIGINT) AS item_no FROM i""")
def mix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.mix_plan(beats(spark, sf_dir))
    return out.select("chapter_id", "pos", "kind", "length_ms", F.col("item_no").cast("long").alias("item_no"))


LINES = f"""
    i AS ({ITEMS}),
    c AS (SELECT *, sum(CASE WHEN type = 'dialogue' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY item_no) AS line_no FROM i),
    d AS (SELECT conv_id, item_no, line_no, item_no // 10000 AS grp, (length(text) * 1000) // 12 + 350 AS whole FROM c WHERE type = 'dialogue'),
    g AS (SELECT *, CASE WHEN lag(grp) OVER w IS NULL THEN 0 WHEN lag(grp) OVER w = grp THEN 250 ELSE 750 END AS gap FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY item_no)),
    lines AS (SELECT conv_id, line_no, CAST(sum(gap + whole) OVER (PARTITION BY conv_id ORDER BY item_no) AS BIGINT) AS e, whole FROM g),
    j AS (SELECT c.conv_id, c.item_no, c.type, c.text, l.e - l.whole AS s, l.e AS e FROM c LEFT JOIN lines l ON l.conv_id = c.conv_id AND l.line_no = c.line_no AND c.type = 'dialogue'),
    k AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY item_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(e) OVER (PARTITION BY conv_id), 0) AS after FROM j),
    entries AS (SELECT conv_id, item_no, type, text, CAST(coalesce(s, before) AS BIGINT) AS start_ms, CAST(CASE WHEN type = 'dialogue' THEN e WHEN type = 'staging' THEN greatest(before, after) ELSE before END AS BIGINT) AS end_ms FROM k)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = script_items(spark, sf_dir).select(F.col("conv_id").alias("scene_id"), "item_no", "type", "text")
    line = F.sum(F.when(F.col("type") == "dialogue", 1).otherwise(0)).over(Window.partitionBy("scene_id").orderBy("item_no")).cast("int")
    chunks = items.withColumn("line_no", line).where("type = 'dialogue'")
    chunks = chunks.select("scene_id", F.col("item_no").alias("pos"), F.floor(F.col("item_no") / 10000).alias("group_id"), "line_no", ms(F.col("text")).alias("duration_ms"))
    return timeline.sync_entries(items, timeline.line_times(chunks))


@query(f"WITH {LINES} SELECT conv_id AS scene_id, item_no, type, start_ms, end_ms FROM entries")
def sync_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("scene_id", "item_no", "type", "start_ms", "end_ms")


_T = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"""
    WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, item_no) AS n, CASE WHEN end_ms <= start_ms THEN start_ms + 1500 ELSE end_ms END AS shown FROM entries)
    SELECT conv_id AS scene_id, CAST(n AS BIGINT) AS n, n || chr(10) || {_T.format('start_ms')} || ' --> ' || {_T.format('shown')} || chr(10) || CASE type WHEN 'dialogue' THEN text WHEN 'staging' THEN '[' || text || ']' ELSE '♪ ' || text END AS block FROM n""")
def srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.srt_blocks(_entries(spark, sf_dir))


@query("""
    WITH s AS (SELECT conv_id // 10 AS play_id, conv_id AS scene_no, CAST(sum((length(text) * 1000) // 12) AS BIGINT) AS length_ms FROM conversations GROUP BY conv_id)
    SELECT play_id, scene_no, length_ms, CAST(coalesce(sum(length_ms + 1000) OVER (PARTITION BY play_id ORDER BY scene_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM s""")
def play_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = beats(spark, sf_dir).groupBy(F.col("chapter_id").alias("play_id"), F.col("scene_id").alias("scene_no")).agg(F.sum("duration_ms").alias("length_ms"))
    return timeline.play_offsets(scenes)


@query(f"""
    WITH {TIMELINE}, p AS (SELECT chapter_id, k, start + k * 30000 AS t FROM (SELECT chapter_id, min(start_ms) AS start, max(end_ms) AS stop FROM timeline GROUP BY chapter_id), range(0, (SELECT max(end_ms) // 30000 + 1 FROM timeline)) r(k) WHERE start + k * 30000 < stop)
    SELECT p.chapter_id, CAST(p.t AS BIGINT) AS t, b.pos FROM p JOIN timeline b ON b.chapter_id = p.chapter_id AND b.start_ms <= p.t AND p.t < b.end_ms""")
def active_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What plays at every half minute of a chapter."""
    placed = timeline.beat_timeline(beats(spark, sf_dir))
    spans = placed.groupBy("chapter_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    points = spans.select("chapter_id", F.explode(F.expr("sequence(a, b - 1, 30000L)")).alias("t"))
    return timeline.active_beats(points, placed.select("chapter_id", "pos", "start_ms", "end_ms"), "chapter_id").select("chapter_id", "t", "pos")


@query(f"""
    WITH {TIMELINE}, m AS (SELECT chapter_id, pos AS mark_no, start_ms + 1000 AS at FROM timeline WHERE pos % 7 = 0)
    SELECT m.chapter_id, m.mark_no, CAST(m.at AS BIGINT) AS at, (SELECT max(pos) FROM timeline b WHERE b.chapter_id = m.chapter_id AND b.end_ms <= m.at) AS after_pos,
           (SELECT min(pos) FROM timeline b WHERE b.chapter_id = m.chapter_id AND b.start_ms >= m.at) AS before_pos FROM m""")
def image_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks a second into every seventh beat, between the beats before and after."""
    placed = timeline.beat_timeline(beats(spark, sf_dir))
    marks = placed.where("pos % 7 = 0").select("chapter_id", F.col("pos").alias("mark_no"), (F.col("start_ms") + 1000).alias("at"))
    spans = placed.select("chapter_id", "pos", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return timeline.nearest_beats(marks, spans, "chapter_id")


@query(f"""
    WITH {TIMELINE}, v AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY pos) - 1 AS p FROM timeline), e AS (SELECT chapter_id, p // 10 AS element_no, p - 1 AS q FROM v WHERE p % 10 = 0 UNION ALL SELECT chapter_id, 1000000, max(p) + 5 FROM v GROUP BY chapter_id),
    f AS (SELECT e.chapter_id, element_no, q, max(pos) FILTER (p <= q) AS after_pos, min(pos) FILTER (p > q) AS before_pos FROM e LEFT JOIN v USING (chapter_id) GROUP BY ALL)
    SELECT f.chapter_id, CAST(element_no AS BIGINT) AS element_no, CAST(q AS BIGINT) AS after_paragraph, after_pos, before_pos,
           CAST(CASE WHEN after_pos IS NULL THEN 0 ELSE coalesce(y.start_ms, x.end_ms) END AS BIGINT) AS trigger_ms
    FROM f LEFT JOIN timeline x ON x.pos = after_pos LEFT JOIN timeline y ON y.pos = before_pos""")
def visual_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element before every tenth beat of a chapter, and one beyond its last."""
    placed = timeline.beat_timeline(beats(spark, sf_dir))
    placed = placed.withColumn("source_paragraph", F.row_number().over(Window.partitionBy("chapter_id").orderBy("pos")) - 1)
    elements = placed.where("source_paragraph % 10 = 0").select("chapter_id", F.floor(F.col("source_paragraph") / 10).alias("element_no"), (F.col("source_paragraph") - 1).cast("long").alias("after_paragraph"))
    last = placed.groupBy("chapter_id").agg((F.max("source_paragraph") + 5).cast("long").alias("after_paragraph")).select("chapter_id", F.lit(1_000_000).cast("long").alias("element_no"), "after_paragraph")
    return timeline.visual_placement(elements.unionByName(last), placed, "chapter_id")
