"""Queries on syncing, finishing and checks. Beats are the turns of conversations, whose places follow from their lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import numbers, strings
from loomline.operators import direction, finishing, guards, scripts, segments, sync, timeline
from loomline.plans.registry import query, table
from loomline.plans.text_queries import ITEMS, script_items
from loomline.plans.timeline_queries import TIMELINE, beats

# Every fifth turn stands nowhere; files change every third turn, and every eleventh turn is in none.
MATCHES = """
    c AS (SELECT conv_id // 10 AS chapter_id, conv_id * 10000 + turn AS pos, conv_id, turn, text, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE conv_id || '-' || turn // 3 END AS xhtml FROM conversations),
    p AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY chapter_id ORDER BY pos) - length(text) - 1 AS s FROM c),
    m AS (SELECT chapter_id, pos, 'b' || pos AS beat_id, text, xhtml, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'none' WHEN turn % 2 = 0 THEN 'span-exact' ELSE 'fuzzy+pass2' END AS confidence,
          CASE WHEN (conv_id + turn) % 5 <> 0 THEN CAST(s AS BIGINT) END AS s, CASE WHEN (conv_id + turn) % 5 <> 0 THEN CAST(s + length(text) AS BIGINT) END AS e FROM p)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n, t = F.col("conv_id"), F.col("turn")
    lost = (n + t) % 5 == 0
    end = F.sum(F.length("text") + 1).over(Window.partitionBy("chapter_id").orderBy("pos")) - 1
    rows = c.select(F.floor(n / 10).alias("chapter_id"), (n * 10000 + t).alias("pos"), "conv_id", "turn", "text", F.when((n + t) % 11 == 0, "").otherwise(F.concat_ws("-", n, F.floor(t / 3))).alias("xhtml")).withColumn("e", end)
    confidence = F.when(lost, "none").when(t % 2 == 0, "span-exact").otherwise("fuzzy+pass2")
    return rows.select("chapter_id", "pos", F.concat(F.lit("b"), F.col("pos").cast("string")).alias("beat_id"), "text", "xhtml", confidence.alias("confidence"), F.when(~lost, F.col("e") - F.length("text")).alias("s"), F.when(~lost, F.col("e")).alias("e"))


@query(f"""
    WITH {MATCHES}, x AS (SELECT chapter_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (confidence <> 'none') AS BIGINT) AS matched FROM m GROUP BY chapter_id)
    SELECT chapter_id, total, matched, CAST((2000 * matched + total) // (2 * total) AS DOUBLE) / 10 AS percent FROM x""")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.match_rates(matches(spark, sf_dir))


@query(f"WITH {MATCHES} SELECT chapter_id, beat_id, left(text, 120) AS text_preview, 'no anchor in chapter source' AS reason FROM m WHERE confidence = 'none'")
def unmatched_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.unmatched(matches(spark, sf_dir))


@query(f"""
    WITH {MATCHES} SELECT chapter_id, pos, CAST(coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_end,
        first_value(s IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_start FROM m""")
def match_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches around every beat."""
    return sync.brackets(matches(spark, sf_dir)).select("chapter_id", "pos", "before_end", "after_start")


# Text nodes of 700 characters with a gap of one behind them, in files of three nodes.
NODES = "g AS (SELECT chapter_id, k, k * 701 AS s, k * 701 + 700 AS e, 'file-' || k // 3 AS xhtml FROM (SELECT chapter_id, max(e) AS n FROM m GROUP BY chapter_id), range(0, (SELECT max(e) // 701 + 1 FROM m)) r(k) WHERE k * 701 < n AND k % 7 <> 5)"


def nodes(found: DataFrame) -> DataFrame:
    spans = found.groupBy("chapter_id").agg(F.max("e").alias("n")).where("n > 0").select("chapter_id", F.explode(F.expr("sequence(0L, (n - 1) div 701)")).alias("k")).where("k % 7 <> 5")
    return spans.select("chapter_id", "k", (F.col("k") * 701).alias("s"), (F.col("k") * 701 + 700).alias("e"), F.concat(F.lit("file-"), F.floor(F.col("k") / 3).cast("string")).alias("xhtml"))


@query(f"WITH {MATCHES}, {NODES} SELECT m.chapter_id, beat_id, coalesce(g.xhtml, '') AS xhtml FROM m LEFT JOIN g ON g.chapter_id = m.chapter_id AND g.s <= m.s AND m.s < g.e WHERE m.s IS NOT NULL")
def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file in whose text node each match begins; some begin between two nodes, or in a lost one."""
    found = matches(spark, sf_dir).where("s is not null")
    return sync.containing(found.select("chapter_id", "beat_id", "s"), nodes(found))


@query(f"WITH {MATCHES} SELECT xhtml, arg_min(beat_id, pos) AS first_beat, arg_max(beat_id, pos) AS last_beat FROM m WHERE confidence <> 'none' AND xhtml <> '' GROUP BY xhtml")
def file_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.first_and_last(matches(spark, sf_dir).where("confidence <> 'none'"))


@query(f"""
    WITH {MATCHES}, f AS (SELECT xhtml, arg_min(beat_id, pos) AS first_beat, arg_max(beat_id, pos) AS last_beat FROM m WHERE confidence <> 'none' AND xhtml <> '' GROUP BY xhtml),
    sp AS (SELECT DISTINCT conv_id // 10 AS book_id, conv_id * 100 + turn // 3 * 2 AS spine_idx, conv_id || '-' || turn // 3 AS xhtml, 0 AS images FROM conversations
           UNION ALL SELECT DISTINCT conv_id // 10, conv_id * 100 + turn // 3 * 2 + 1, 'insert-' || conv_id || '-' || turn // 3, 2 FROM conversations),
    j AS (SELECT sp.*, first_beat, last_beat FROM sp LEFT JOIN f USING (xhtml)),
    w AS (SELECT *, last_value(last_beat IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY spine_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_beat,
          first_value(first_beat IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY spine_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS before_beat FROM j)
    SELECT book_id, spine_idx, xhtml, after_beat, before_beat FROM w WHERE images > 0 AND first_beat IS NULL""")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of images behind each file, between the beats of the nearest texts."""
    n, t = F.col("conv_id"), F.floor(F.col("turn") / 3)
    c = table(spark, sf_dir, "conversations")
    texts = c.select(F.floor(n / 10).alias("book_id"), (n * 100 + t * 2).alias("spine_idx"), F.concat_ws("-", n, t).alias("xhtml"), F.lit(0).alias("images")).distinct()
    inserts = texts.select("book_id", (F.col("spine_idx") + 1).alias("spine_idx"), F.concat(F.lit("insert-"), "xhtml").alias("xhtml"), F.lit(2).alias("images"))
    return sync.image_pages(texts.unionByName(inserts), sync.first_and_last(matches(spark, sf_dir).where("confidence <> 'none'")))


@query(f"""
    WITH {MATCHES}, n AS (SELECT chapter_id, pos // 10000 AS part_no, pos % 10000 AS node_no, length(text) AS k FROM m),
    l AS (SELECT *, sum(k + 1) OVER (PARTITION BY chapter_id, part_no ORDER BY node_no) - k - 1 AS s FROM n),
    b AS (SELECT chapter_id, part_no, coalesce(sum(z) OVER (PARTITION BY chapter_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT chapter_id, part_no, max(s + k) + 1 AS z FROM l GROUP BY ALL))
    SELECT chapter_id, part_no, node_no, CAST(s + base AS BIGINT) AS s, CAST(s + k + base AS BIGINT) AS e FROM l JOIN b USING (chapter_id, part_no)""")
def master_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text nodes, conversations as the parts of a chapter: places counted through the chapter."""
    c = table(spark, sf_dir, "conversations")
    own = F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = c.select(F.floor(F.col("conv_id") / 10).alias("chapter_id"), F.col("conv_id").alias("part_no"), F.col("turn").alias("node_no"), (own - F.length("text")).alias("s"), own.alias("e"))
    return sync.master_shadow(rows).select("chapter_id", "part_no", "node_no", "s", "e")


@query(f"""
    WITH {MATCHES}, h AS (SELECT count(*) AS a, count(*) FILTER (confidence <> 'none') AS b, count(*) FILTER (confidence = 'span-exact') AS x, count(*) FILTER (confidence = 'fuzzy+pass2') AS f FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY pos) AS n FROM m WHERE confidence <> 'none')
    SELECT 'head' AS section, CAST(0 AS BIGINT) AS n, '{{"book_id":"a/b","total_beats":' || a || ',"matched":' || b || ',"unmatched":' || (a - b) || ',"match_confidence":{{"anchored":0,"backtrack":0,"exact":0,"fuzzy":' || f || ',"head-only":0,"span-exact":' || x
        || ',"tail-only":0}},"silences":{{"intra_ms":250,"inter_scene_ms":1000,"inter_chapter_ms":2000}}}}' AS item FROM h
    UNION ALL SELECT 'beat', CAST(n AS BIGINT), '{{"chapter_id":' || chapter_id || ',"beat_id":"' || beat_id || '","xhtml":"' || xhtml || '","match_confidence":"' || confidence || '"}}' FROM k
    UNION ALL SELECT 'image', CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY pos) AS BIGINT), '{{"chapter_id":' || chapter_id || ',"src":"i' || pos || '.png"}}' FROM m WHERE pos % 7 = 0""")
def sync_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a book whose chapters are all conversations, with an image at every seventh place."""
    found = matches(spark, sf_dir)
    images = found.where("pos % 7 = 0").select("chapter_id", F.concat(F.lit("i"), F.col("pos").cast("string"), F.lit(".png")).alias("src"), F.col("pos").alias("__pos"))
    images = images.select("chapter_id", F.struct("__pos", "src").alias("o")).select("chapter_id", F.col("o.src").alias("src"), F.col("o.__pos").alias("pos"))
    nothing = spark.createDataFrame([], "chapter_id long, kind string")
    return sync.manifest("a/b", found.select("chapter_id", "pos", "beat_id", "xhtml", "confidence"), images, nothing)


@query(f"""
    WITH {TIMELINE}, t AS (SELECT book_id, chapter_id, max(end_ms) - min(start_ms) AS total_ms FROM timeline GROUP BY ALL),
    s AS (SELECT *, coalesce(sum(total_ms + 2000) OVER (PARTITION BY book_id ORDER BY chapter_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, CASE WHEN chapter_id % 3 = 0 THEN CAST(chapter_id AS VARCHAR) ELSE 'Chapter ' || chapter_id END AS title FROM t)
    SELECT book_id, ';FFMETADATA1' || chr(10) || 'title=Book ' || book_id || chr(10) || string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(start_ms AS BIGINT) || chr(10) || 'END=' || CAST(start_ms + total_ms AS BIGINT) || chr(10) || 'title=' || title, chr(10) ORDER BY start_ms) || chr(10) AS text FROM s GROUP BY book_id""")
def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter marks of each book; every third chapter has no title of its own."""
    placed = timeline.beat_timeline(beats(spark, sf_dir))
    totals = placed.groupBy("book_id", "chapter_id").agg((F.max("end_ms") - F.min("start_ms")).alias("total_ms"))
    titles = totals.where("chapter_id % 3 <> 0").select("chapter_id", F.concat(F.lit("Chapter "), F.col("chapter_id").cast("string")).alias("title"))
    timings = finishing.titled(finishing.chapter_timings(totals), titles)
    books = totals.select("book_id").distinct().withColumn("title", F.concat(F.lit("Book "), F.col("book_id").cast("string")))
    return finishing.ffmetadata(timings, books)


@query("""
    WITH plan AS (SELECT DISTINCT l_partkey AS cache_key, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 97 END AS ref_hash FROM lineitem),
    chunks AS (SELECT DISTINCT l_partkey AS cache_key, l_partkey * 10 + l_linenumber AS item_id FROM lineitem),
    live AS (SELECT * FROM plan WHERE cache_key % 2 = 0), parts AS (SELECT * FROM chunks WHERE cache_key % 2 = 0)
    SELECT 'refs' AS phase, CAST(count(DISTINCT ref_hash) AS BIGINT) AS n FROM live WHERE ref_hash IS NOT NULL AND ref_hash % 3 <> 0
    UNION ALL SELECT 'ctx', CAST(1 + (SELECT count(*) FROM parts WHERE item_id % 4 <> 0) AS BIGINT) UNION ALL SELECT 'denoise', CAST(count(*) AS BIGINT) FROM parts WHERE item_id % 7 <> 0 UNION ALL SELECT 'decode', CAST(count(*) AS BIGINT) FROM live""")
def pending_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each phase of a plan over parts, half of which are rendered; the negative prompt isn't there yet."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    plan = li.select(k.cast("string").alias("cache_key"), F.when(k % 5 != 0, (k % 97).cast("string")).alias("ref_hash")).distinct()
    chunks = li.select(k.cast("string").alias("cache_key"), (k * 10 + F.col("l_linenumber")).alias("item_id")).distinct()
    done = {
        "renders": plan.where("cast(cache_key as long) % 2 <> 0").select("cache_key"), "refs": plan.where("cast(ref_hash as long) % 3 = 0").select("ref_hash").distinct(),
        "contexts": chunks.where("item_id % 4 = 0"), "latents": chunks.where("item_id % 7 = 0"), "negative": plan.where("false"),
    }
    return finishing.pending_by_phase(plan, chunks, done, scale=2.5)


@query("""
    WITH b AS (SELECT o_orderkey // 100 AS chapter_id, o_orderkey AS beat_id, o_custkey AS cache_key FROM orders), c AS (SELECT c_custkey AS cache_key, c_custkey % 50 AS modified, 1000 + c_custkey AS duration_ms FROM customer),
    p AS (SELECT beat_id, beat_id % 60 AS modified FROM b WHERE beat_id % 4 <> 0)
    SELECT chapter_id, beat_id, cache_key, CASE WHEN p.modified IS NULL OR c.modified > p.modified THEN 'copy' ELSE 'keep' END AS action, CAST(duration_ms AS BIGINT) AS duration_ms FROM b LEFT JOIN c USING (cache_key) LEFT JOIN p USING (beat_id)""")
def render_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as beats whose sounds are customers': missing and outdated files are copied anew."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.select(F.floor(F.col("o_orderkey") / 100).alias("chapter_id"), F.col("o_orderkey").alias("beat_id"), F.col("o_custkey").alias("cache_key"))
    cache = c.select(F.col("c_custkey").alias("cache_key"), (F.col("c_custkey") % 50).alias("modified"), (1000 + F.col("c_custkey")).cast("long").alias("duration_ms"))
    placed = rows.where("beat_id % 4 <> 0").select("beat_id", (F.col("beat_id") % 60).alias("modified"))
    return finishing.placements(rows, cache, placed)


@query("""
    SELECT conv_id AS chapter_id, conv_id || '_' || turn AS beat_id, left(sha256(text || chr(31)), 16) AS cache_key, turn % 2 = 0 AS has_sound, left(sha256(text || chr(31)), 16) < '8' AS has_cached FROM conversations WHERE role = 'user'""")
def purge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge of one speaker would delete."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("chapter_id"), F.concat_ws("_", "conv_id", "turn").alias("beat_id"), F.col("role").alias("speaker"), strings.content_key(F.col("text")).alias("cache_key"), "turn")
    sounds, cached = rows.where("turn % 2 = 0").select("beat_id"), rows.where("cache_key < '8'").select("cache_key")
    return finishing.purge_plan(rows.drop("turn"), " USER", sounds, cached)


@query("""
    WITH s AS (SELECT DISTINCT conv_id AS chapter_id, turn // 3 AS scene_id FROM conversations), b AS (SELECT conv_id AS chapter_id, turn // 3 AS scene_id FROM conversations WHERE NOT (conv_id % 4 = 1 AND turn >= 3))
    SELECT DISTINCT chapter_id FROM s LEFT JOIN (SELECT chapter_id, scene_id, count(*) AS n FROM b GROUP BY ALL) USING (chapter_id, scene_id) WHERE n IS NULL UNION SELECT -1""")
def degenerate_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chapters, of which some have a scene without beats; one chapter has no scene at all."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), F.floor(F.col("turn") / 3).alias("scene_id"), "turn")
    chapters = c.select("chapter_id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("chapter_id")))
    return guards.degenerate_chapters(chapters, c.select("chapter_id", "scene_id"), c.where("not (chapter_id % 4 = 1 and turn >= 3)"))


@query("""
    WITH a AS (SELECT l_orderkey AS chapter_id, count(*) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS chapter_id, count(*) AS y FROM lineitem WHERE NOT (l_orderkey % 6 = 0 AND l_linenumber > 2) AND l_orderkey % 10 <> 0 GROUP BY 1)
    SELECT chapter_id, CAST(x AS BIGINT) AS n_left, CAST(coalesce(y, 0) AS BIGINT) AS n_right FROM a LEFT JOIN b USING (chapter_id) WHERE x <> coalesce(y, 0)""")
def count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter_id"), "l_linenumber")
    return guards.count_mismatches(li, li.where("not (chapter_id % 6 = 0 and l_linenumber > 2) and chapter_id % 10 <> 0"))


@query("""
    WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
    b AS (SELECT conv_id, k // 3 AS batch_no, string_agg('[' || k % 3 || '] ' || text, chr(10) ORDER BY k) AS passages, sum(length(text)) AS chars FROM r GROUP BY ALL)
    SELECT conv_id, CAST(batch_no AS BIGINT) AS batch_no, passages, CAST(chars AS BIGINT) AS chars FROM b""")
def normalise_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of three turns each."""
    c = table(spark, sf_dir, "conversations").withColumn("source_span", F.col("text"))
    return direction.batches(c, "conv_id", "turn", 3)


@query("""
    WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
    SELECT conv_id, turn, CASE WHEN (conv_id + k // 3) % 2 = 0 AND k % 3 = 1 THEN 'Spoken ' || k ELSE text END AS text FROM r""")
def normalised_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for the second passage of every other batch, blank ones for the third: all else stays word for word."""
    c = table(spark, sf_dir, "conversations")
    k = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    rows = c.select("conv_id", "turn", "text").withColumn("k", k)
    answers = rows.where("(conv_id + k div 3) % 2 = 0 and k % 3 > 0").select("conv_id", F.expr("k div 3").alias("batch_no"), (F.col("k") % 3).alias("i"), F.when(F.col("k") % 3 == 1, F.concat(F.lit(" Spoken "), F.col("k").cast("string"))).otherwise("  ").alias("text"))
    return direction.normalised(rows.drop("k"), answers, "conv_id", "turn", 3)


@query("SELECT conv_id AS chapter_id, turn AS pos, CAST(length(text) * 3 AS BIGINT) AS duration_ms FROM conversations")
def positional_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the lengths of renders that are numbered otherwise."""
    c = table(spark, sf_dir, "conversations")
    left = c.select(F.col("conv_id").alias("chapter_id"), F.col("turn").alias("pos"))
    right = c.select(F.col("conv_id").alias("chapter_id"), (F.col("turn") * 5 + 2).alias("pos"), (F.length("text") * 3).cast("long").alias("duration_ms"))
    return direction.positional(left, right)


@query(r"""
    WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS bs, text FROM documents),
    w AS (SELECT doc_id, bs, 1 AS i, 0 AS part, length(bs[1]) + 2 AS size FROM t WHERE length(array_to_string(bs, chr(10) || chr(10))) > 700
          UNION ALL SELECT doc_id, bs, i + 1, CASE WHEN size + length(bs[i + 1]) > 700 THEN part + 1 ELSE part END, CASE WHEN size + length(bs[i + 1]) > 700 THEN length(bs[i + 1]) + 2 ELSE size + length(bs[i + 1]) + 2 END FROM w WHERE i < len(bs))
    SELECT doc_id, CAST(part AS BIGINT) AS part_no, string_agg(bs[i], chr(10) || chr(10) ORDER BY i) AS chunk FROM w GROUP BY doc_id, part
    UNION ALL SELECT doc_id, 0, array_to_string(bs, chr(10) || chr(10)) FROM t WHERE length(array_to_string(bs, chr(10) || chr(10))) <= 700""")
def script_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines between their lines, in parts of 700 characters."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    text = F.regexp_replace("text", r"\n+", "\n\n")
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    out = docs.select("doc_id", F.posexplode(segments.split_script(text, 700)).alias("part_no", "chunk"))
    return out.withColumn("part_no", F.col("part_no").cast("long"))


LABELS = "CASE conv_id % 6 WHEN 0 THEN 'Tous' WHEN 1 THEN '**ANNA**' WHEN 2 THEN 'ANNA (off) –' ELSE 'Role ' || conv_id % 17 END"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    label = F.when(n % 6 == 0, "Tous").when(n % 6 == 1, "**ANNA**").when(n % 6 == 2, "ANNA (off) –").otherwise(F.concat(F.lit("Role "), (n % 17).cast("string")))
    items = script_items(spark, sf_dir)
    return items.select((n * 1_000_000 + F.col("item_no")).alias("item_no"), "type", label.alias("speaker"), "text")


@query(f"""
    WITH i AS (SELECT conv_id * 1000000 + item_no AS item_no, type, {LABELS} AS speaker, text FROM ({ITEMS})),
    r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY item_no) AS k FROM i WHERE type = 'dialogue' AND speaker <> 'Tous')
    SELECT CAST(row_number() OVER (ORDER BY min(item_no)) AS BIGINT) AS place, speaker, string_agg(left(text, 160), '|' ORDER BY k) AS lines, CASE WHEN speaker LIKE '%ANNA%' THEN 'A baker' ELSE '' END AS bio FROM r WHERE k <= 2 GROUP BY speaker""")
def script_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers with their first two lines and what the cast list says of them; everybody together is nobody."""
    roster = spark.createDataFrame([("Anna (a baker)", "A baker"), ("Nobody", "x")], "name string, description string")
    out = scripts.rostered(scripts.sample_lines(_labelled(spark, sf_dir)), roster)
    return out.select("place", "speaker", F.array_join("lines", "|").alias("lines"), "bio")


@query(f"""
    WITH i AS (SELECT {LABELS} AS speaker FROM ({ITEMS})), l AS (SELECT DISTINCT speaker FROM i)
    SELECT speaker AS label, CASE WHEN speaker LIKE '%ANNA%' THEN CASE WHEN (SELECT count(*) FROM i WHERE speaker = '**ANNA**') > (SELECT count(*) FROM i WHERE speaker = 'ANNA (off) –') THEN 'ANNA' ELSE 'ANNA (off)' END ELSE speaker END AS canonical FROM l""")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label for all variants of a speaker's."""
    return scripts.canonical_labels(_labelled(spark, sf_dir))


@query("""
    SELECT doc_id, CAST(greatest(1024, least(8192, 80 * (length(text) // 100) + 512)) AS BIGINT) AS boundaries, CAST(greatest(4096, least(32000, 2 * length(text) + 1024)) AS BIGINT) AS beats,
           CAST(greatest(2048, length(text) // 2 + 1024) AS BIGINT) AS normalise, CAST(greatest(4096, 400 * (length(text) // 100) + 1024) AS BIGINT) AS profiles, greatest(3.0, round_even(CAST(length(text) / 16.0 AS DOUBLE), 1)) AS seconds FROM documents WHERE text IS NOT NULL""")
def stage_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    parts = F.floor(n / 100)
    docs = table(spark, sf_dir, "documents").where("text is not null")
    kinds = [numbers.stage_budget(k, u).alias(k) for k, u in (("boundaries", parts), ("beats", n), ("normalise", n), ("profiles", parts))]
    return docs.select("doc_id", *kinds, numbers.estimated_seconds(n / 16.0).alias("seconds"))


@query("""
    WITH x AS (SELECT conv_id, turn, role || ' voice' AS d, text FROM conversations)
    SELECT conv_id, turn, unnest(['comma', 'brackets', 'brackets+NL', 'period', 'colon', 'dash', 'line only']) AS label,
        unnest([d || ', "' || text || '"', '[' || d || '] "' || text || '"', '[' || d || ']' || chr(10) || '"' || text || '"', d || '. "' || text || '"', d || ': "' || text || '"', d || ' — "' || text || '"', '"' || text || '"']) AS prompt FROM x""")
def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in each form of a prompt."""
    c = table(spark, sf_dir, "conversations")
    forms = strings.prompt_forms(F.concat("role", F.lit(" voice")), F.col("text"))
    return c.select("conv_id", "turn", F.explode(forms).alias("f")).select("conv_id", "turn", "f.label", "f.prompt")


@query(r"""
    WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE 'Speaker ' || (turn % 4 + 1) || ': ' || text || chr(10) || chr(10) || ' speaker ' || (turn % 3) || ' : end' END AS p FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Speaker 1: ' || trim(regexp_replace(p, '\s+', ' ', 'g')) ELSE array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)) END AS script,
           CAST(CASE WHEN turn % 3 = 0 THEN 1 ELSE greatest(turn % 4 + 1, turn % 3) END AS BIGINT) AS speakers FROM x""")
def speaker_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts, most of them with numbered speakers."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    numbered = F.concat(F.lit("Speaker "), (t % 4 + 1).cast("string"), F.lit(": "), "text", F.lit("\n\n speaker "), (t % 3).cast("string"), F.lit(" : end"))
    found = strings.speaker_script(F.when(t % 3 == 0, F.col("text")).otherwise(numbered))
    return c.select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", "f.script", "f.speakers")


@query(r"SELECT page_id, replace(replace(url, '/', '_'), chr(92), '_') AS file_name, NOT regexp_matches(url, '\p{Lu}') AS generic FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as file names, and whether they would pass as mere descriptors."""
    return table(spark, sf_dir, "pages").select("page_id", strings.safe_filename(F.col("url")).alias("file_name"), strings.generic_alias(F.col("url")).alias("generic"))


@query("""
    WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'bnb4' ELSE 'fp16' END AS e, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS cap, CASE WHEN p_partkey % 5 = 0 THEN 'fp32' ELSE '' END AS d FROM part),
    y AS (SELECT p_partkey, concat_ws('+', CASE WHEN e <> 'bnb4' THEN 'enc-' || e END, 'cap' || cap, CASE WHEN d <> '' THEN 'dec-' || d END) AS t FROM x)
    SELECT p_partkey, CASE WHEN t = '' THEN '' ELSE '+' || t END AS tag FROM y""")
def variant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    cap = F.when(k % 2 == 0, F.col("p_size").cast("double"))
    return p.select("p_partkey", strings.variant_tag(F.when(k % 3 == 0, "bnb4").otherwise("fp16"), cap, F.when(k % 5 == 0, "fp32").otherwise("")).alias("tag"))
