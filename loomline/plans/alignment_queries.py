"""Queries on alignment, pages, providers and audio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators import alignment, pages, providers, rendering, segments
from loomline.operators.cut import spread
from loomline.plans.registry import query, table
from loomline.plans.text_queries import PACKED_CTES

STRAIGHT = "'" + "''" * 4 + '"' * 5 + "-" * 5 + "'"
NORM = r"trim(regexp_replace(lower(translate({0}, '‘’‚‛“”„«»–—‒―−', " + STRAIGHT + r")), '\s+', ' ', 'g'))"
SPANS = f"""
    SELECT doc_id, item_id, CAST(strpos(d, n) - 1 AS BIGINT) AS s, CAST(strpos(d, n) - 1 + length(n) AS BIGINT) AS e
    FROM (SELECT doc_id, {NORM.format('text')} AS d FROM documents), (SELECT item_id, {NORM.format('text')} AS n FROM benchmark) WHERE n <> '' AND contains(d, n)"""


@query(SPANS)
def span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each benchmark passage stands in each document: a stated query set against all rows."""
    return alignment.span_matches(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


# Every packed piece of every document, and its beginning with an end that isn't there.
ANCHORED = f"""
    {PACKED_CTES},
    raw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, piece) - 1 AS k, t FROM pieces),
    b AS (SELECT doc_id, k * 2 AS pos, {NORM.format('t')} AS n FROM raw UNION ALL SELECT doc_id, k * 2 + 1, {NORM.format("left(t, 100) || ' never there'")} FROM raw),
    f AS (SELECT doc_id, {NORM.format('text')} AS d FROM documents),
    h AS (SELECT doc_id, pos, n, d, length(n) AS k, strpos(d, n) AS x, strpos(d, left(n, 30)) AS h FROM b JOIN f USING (doc_id)),
    t AS (SELECT *, strpos(substr(d, h + 30, greatest(2 * k + 300, 1000) - 30), right(n, 30)) AS t FROM h),
    m AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN k <= 60 AND k > 0 AND x > 0 THEN 'exact' WHEN k > 60 AND h > 0 AND t > 0 THEN 'anchored' ELSE 'none' END AS confidence, k, x, h, t FROM t),
    matches AS (SELECT doc_id, pos, confidence, CAST(CASE confidence WHEN 'exact' THEN x - 1 WHEN 'anchored' THEN h - 1 END AS BIGINT) AS s, CAST(CASE confidence WHEN 'exact' THEN x - 1 + k WHEN 'anchored' THEN h - 1 + 30 + t - 1 + 30 END AS BIGINT) AS e FROM m)"""


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = docs.select("doc_id", "text", segments.chapter_pieces(F.col("text"), "\n").alias("pieces"))
    piece = F.transform("pieces", lambda t, i: F.struct((i * 2).cast("long").alias("pos"), t.alias("text")))
    cut = F.transform("pieces", lambda t, i: F.struct((i * 2 + 1).cast("long").alias("pos"), F.concat(F.left(t, F.lit(100)), F.lit(" never there")).alias("text")))
    return alignment.anchored_matches(pieces.select("doc_id", "text", F.concat(piece, cut).alias("beats")))


@query(f"WITH RECURSIVE {ANCHORED} SELECT doc_id, pos, s, e, confidence FROM matches")
def anchored_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of whole texts: every packed piece of every document, and its beginning with an end that isn't there."""
    return _anchored(spark, sf_dir)


@query(f"""
    WITH RECURSIVE {ANCHORED} SELECT confidence, CAST(count(doc_id) AS BIGINT) AS n
    FROM (SELECT unnest(['span-exact', 'exact', 'anchored', 'head-only', 'tail-only', 'backtrack', 'fuzzy', 'none']) AS confidence) LEFT JOIN matches USING (confidence) GROUP BY confidence""")
def match_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.match_histogram(_anchored(spark, sf_dir))


@query(r"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_no, length(unnest(string_split(text, chr(10)))) AS n FROM documents),
    s AS (SELECT doc_id, seg_no, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY seg_no) - n - 1 AS s, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS e FROM l),
    m AS (SELECT doc_id, k AS match_no, k * 300 AS s, k * 300 + 200 AS e FROM documents, range(0, (SELECT max(length(text)) // 300 + 1 FROM documents)) r(k) WHERE k * 300 < length(text))
    SELECT s.doc_id, CAST(seg_no AS BIGINT) AS seg_no, CAST(match_no AS BIGINT) AS match_no, CAST(greatest(s.s, m.s) AS BIGINT) AS s, CAST(least(s.e, m.e) AS BIGINT) AS e
    FROM s JOIN m ON m.doc_id = s.doc_id AND s.s < m.e AND m.s < s.e AND s.e > s.s""")
def segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document against spans of 200 characters at every 300."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "line"))
    end = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("seg_no"))
    spans = lines.select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), (end - F.length("line") - 1).alias("s"), (end - 1).alias("e"))
    marks = docs.where("length(text) > 0").select("doc_id", F.explode(F.expr("sequence(0L, (length(text) - 1) div 300)")).alias("match_no"))
    marks = marks.select("doc_id", "match_no", (F.col("match_no") * 300).alias("s"), (F.col("match_no") * 300 + 200).alias("e"))
    return alignment.overlapping(spans, marks, "doc_id")


def ladder_rows(docs: DataFrame) -> DataFrame:
    """Documents with their packed pieces as beats: every second one knows its span, every third one has lost its middle."""
    cut = lambda t: F.concat(F.left(t, F.lit(40)), F.lit(" … "), F.right(t, F.lit(40)))

    def beat(t, i):
        text = F.when((i % 3 == 0) & (F.length(t) > 100), cut(t)).otherwise(t)
        return F.struct(i.cast("long").alias("pos"), text.alias("text"), F.when(i % 2 == 0, t).alias("source_span"))

    pieces = spread(docs.select("doc_id", "text")).select("doc_id", "text", segments.chapter_pieces(F.col("text"), "\n").alias("pieces"))
    return pieces.select("doc_id", "text", F.transform("pieces", beat).alias("beats"))


@query()
def ladder_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder on every document; tests compare it with a plain version of the rules."""
    return alignment.aligned(ladder_rows(table(spark, sf_dir, "documents")))


# The given pages have a head, and a body of plain tags, comments and few entities; some end in the middle.
_BODY = "regexp_replace(regexp_replace(html, '(?s)^.*</head>', ''), '(?s)<!--.*?-->', chr(1), 'g')"
_TEXT = "replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_SHOWN = f"trim(regexp_replace({_TEXT.format("regexp_replace({0}, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"


@query(f"""
    WITH b AS (SELECT page_id, string_split(replace({_BODY}, chr(1), ' '), '<p>') AS ps FROM pages),
    t AS (SELECT page_id, 0 AS k, 'ul' AS tag, split_part(split_part(ps[1], '<ul>', 2), '</ul>', 1) AS x FROM b UNION ALL SELECT page_id, generate_subscripts(ps, 1), 'p', split_part(split_part(unnest(ps), '</p>', 1), '</article>', 1) FROM b),
    n AS (SELECT page_id, k, tag, {_SHOWN.format('x')} AS text FROM t WHERE k <> 1)
    SELECT page_id, CAST(row_number() OVER w - 1 AS BIGINT) AS block_no, tag, 'prose' AS kind, '' AS language, text, CAST(row_number() OVER w - 1 AS BIGINT) AS after_paragraph FROM n WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY k)""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.block_positions(pages.resolved(pages.page_blocks(table(spark, sf_dir, "pages"))))


@query("""
    SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'stem' WHEN 1 THEN 'landmark' WHEN 2 THEN 'boilerplate' WHEN 3 THEN 'nav' WHEN 4 THEN 'heading'
        WHEN 6 THEN CASE WHEN length(html) - length(replace(html, '<a ', '..')) >= 5 THEN 'links' END END AS reason FROM pages""")
def page_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made to break each rule by their numbers: a stem, a type, a class, no paragraphs, a heading, links alone."""
    v, html = F.col("page_id") % 8, F.col("html")
    shaped = (
        F.when(v == 1, F.replace(html, F.lit("<article>"), F.lit('<section epub:type="index">'))).when(v == 2, F.replace(html, F.lit("<article>"), F.lit('<article class="x pg-boilerplate">')))
        .when(v == 3, F.regexp_replace(html, "</?p>", "")).when(v == 4, F.regexp_replace(html, "<h1>[^<]*</h1>", "<h3>Table of  Contents.</h3>"))
        .when(v == 5, F.regexp_replace(html, "</?(?:p|nav)>", "")).when(v == 6, F.regexp_extract(html, "(?s)<nav>(.*)</nav>", 1)).otherwise(html)
    )
    stem = F.when(v == 0, "toc-2").when(v == 7, "coverage").otherwise("chapter")
    return pages.page_drops(table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"), shaped.alias("html")))


@query(f"""
    WITH t AS (SELECT page_id, generate_subscripts(xs, 1) AS k, {_TEXT.format('unnest(xs)')} AS raw FROM (SELECT page_id, string_split_regex({_BODY}, '<[^>]*>|' || chr(1)) AS xs FROM pages)),
    n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS node_no, raw, regexp_replace(lower(translate(raw, '‘’‚‛“”„«»–—‒―−', {STRAIGHT})), '\\s+', ' ', 'g') AS norm FROM t WHERE trim(raw) <> ''),
    s AS (SELECT *, sum(length(norm) + CASE WHEN norm LIKE '% ' THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY node_no) - length(norm) - CASE WHEN norm LIKE '% ' THEN 0 ELSE 1 END AS s FROM n)
    SELECT page_id, CAST(node_no AS BIGINT) AS node_no, CAST(s AS BIGINT) AS s, CAST(s + length(norm) AS BIGINT) AS e, raw FROM s""")
def page_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_shadow(table(spark, sf_dir, "pages"))


@query()
def dom_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with matches wrapped: each text node that has one, from its second word to the middle of the next node."""
    rows = table(spark, sf_dir, "pages")
    nodes = pages.page_shadow(rows)
    after = F.lead("s").over(Window.partitionBy("page_id").orderBy("node_no"))
    found = nodes.withColumn("next", after).where("node_no % 2 = 0 and e - s > 8")
    found = found.select("page_id", F.concat(F.lit("b"), F.col("node_no").cast("string")).alias("beat_id"), (F.col("s") + 4).alias("s"), F.coalesce(F.col("next") + 3, F.col("e")).alias("e"))
    return alignment.wrapped_pages(rows, found)


@query("""
    WITH x AS (SELECT conv_id || '_' || turn AS beat_id, 800 * (turn % 5) AS a, 800 * (turn % 5) + 4000 + 500 * (turn % 3) AS n FROM conversations),
    k AS (SELECT *, greatest(0, a - 800) AS f, least(n, a + 4800) AS l FROM x)
    SELECT beat_id, CAST(n AS BIGINT) AS frames, CAST(CASE WHEN (n - (l - f)) * 1000 < 50 * 8000 THEN 0 ELSE f END AS BIGINT) AS first, CAST(CASE WHEN (n - (l - f)) * 1000 < 50 * 8000 THEN n ELSE l END AS BIGINT) AS last FROM k""")
def edge_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tone between two silences whose lengths follow from the turn, for every turn."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("beat_id"), "turn")

    def sounds(batches):
        for batch in batches:
            made = [_tone(t) for t in batch.column("turn").to_pylist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("beat_id"), pa.array([8000] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(made, pa.binary())], ["beat_id", "sample_rate", "channels", "pcm"])

    return rendering.edge_trim(turns.mapInArrow(sounds, "beat_id string, sample_rate int, channels int, pcm binary"))


def _tone(turn: int) -> bytes:
    tone = (np.sin(np.arange(4000) / 5) * 8000).astype("<i2")
    return np.concatenate([np.zeros(800 * (turn % 5), "<i2"), tone, np.zeros(500 * (turn % 3), "<i2")]).tobytes()


@query("""
    SELECT conv_id AS answer_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS entry_no, role AS name, text AS aliases FROM conversations""")
def salvage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per conversation that lists its turns, cut short behind them in every other one."""
    turns = table(spark, sf_dir, "conversations")
    item = F.to_json(F.struct(F.col("role").alias("name"), F.col("text").alias("aliases")))
    lists = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), ", ").alias("x"))
    raw = F.concat(F.lit('Here it is:\n```json\n{"characters": ['), "x", F.when(F.col("conv_id") % 2 == 0, "]}\n```").otherwise(', {"name": "cut'))
    found = providers.salvaged(lists.select(F.col("conv_id").alias("answer_id"), raw.alias("raw")))
    return found.select("answer_id", "entry_no", "name", F.array_join("aliases", ", ").alias("aliases"))


@query(r"""
    SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'cached' WHEN contains(text, '!') THEN 'excited' WHEN contains(text, '?') THEN 'curious' ELSE 'calm' END AS emotion FROM conversations""")
def provider_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of even conversations are answered from the cache, the others by the rule-based provider."""
    from loomline.functions import content_key

    turns = table(spark, sf_dir, "conversations").withColumn("prompt", F.concat(F.col("conv_id").cast("string"), F.lit(" "), F.col("text")))
    cache = turns.where("conv_id % 2 = 0").select(content_key(F.lit("cue"), F.col("prompt"), F.lit("rules")).alias("cache_key"), F.lit('{"emotion": "cached"}').alias("answer")).distinct()
    out, _ = providers.answered(turns, "prompt", "cue", "rules", providers.rule_based_cue, cache)
    return out.select("conv_id", "turn", F.get_json_object("answer", "$.emotion").alias("emotion"))


@query(r"""
    WITH b AS (SELECT conv_id || '_b' || turn AS beat_id, conv_id * 10000 + turn AS pos, '(calm) "' || text || '"' AS prompt, role AS ref, (length(text) * 1000) // 12 AS ms, text FROM conversations),
    k AS (SELECT left(sha256(prompt || chr(31) || ref || chr(31) || 'model-1' || chr(31)), 16) AS cache_key, * FROM b),
    r AS (SELECT cache_key, arg_min({'p': prompt, 't': text, 'ms': ms}, pos) AS f FROM k GROUP BY cache_key),
    w AS (SELECT cache_key, f.p AS p, f.ms AS ms, string_split_regex(trim(f.t), '[ \t\n\v\f\r]+') AS ws FROM r),
    n AS (SELECT *, CAST(greatest(1, ceil(len(ws) / greatest(2, ceil(ms / 1000 / 18)))) AS BIGINT) AS size FROM w),
    c AS (SELECT cache_key, 0 AS chunk_no, p AS text FROM n WHERE ms <= 22000
          UNION ALL SELECT cache_key, i, '(calm) "' || array_to_string(ws[i * size + 1:(i + 1) * size], ' ') || '"' FROM n, range(0, 100000) x(i) WHERE ms > 22000 AND i * size < len(ws))
    SELECT cache_key, CAST(chunk_no AS BIGINT) AS chunk_no, text, cache_key || '_c' || lpad(CAST(chunk_no AS VARCHAR), 2, '0') || '-' || left(sha256(text), 8) AS item_id FROM c""")
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all turns' renders: those over the cap are cut by words."""
    turns = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit('(calm) "'), "text", F.lit('"'))
    beats = turns.select(F.concat_ws("_b", "conv_id", "turn").alias("beat_id"), (F.col("conv_id") * 10000 + F.col("turn")).alias("pos"), text.alias("prompt"), F.col("role").alias("ref"), (F.length("text") * 1000 / 12).cast("long").alias("duration_ms"))
    return rendering.render_plan(beats, "ref", "model-1")[1].withColumn("chunk_no", F.col("chunk_no").cast("long"))
