"""Queries on cutting, folding and naming text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import content_key, label_stem, prompt, retry_budget, slug, spoken_text, timeout_seconds, token_budget
from loomline.operators import alignment, folds, segments
from loomline.plans.registry import query, table

# The corpus has single line breaks only, so a paragraph is a line here.
SENTENCES = r"""
    SELECT conv_id, turn, role, unnest(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS s,
           generate_subscripts(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''), 1) AS k
    FROM conversations"""


def sentence_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all turns as beats: scene conv_id, position pos, narration where the system speaks."""
    turns = table(spark, sf_dir, "conversations")
    parts = turns.select("conv_id", "turn", "role", F.posexplode(segments.sentences_of(segments.strip(F.col("text")))).alias("k", "text"))
    kind = F.when(F.col("role") == "system", "narration").otherwise("dialogue")
    return parts.select("conv_id", (F.col("turn") * 10000 + F.col("k")).alias("pos"), kind.alias("type"), F.col("role").alias("speaker"), "text")


@query("""
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS chapter_id, regexp_replace(split_part(t, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS title,
           CAST(CASE WHEN strpos(t, chr(10)) = 0 THEN 0 ELSE length(regexp_replace(substr(t, strpos(t, chr(10)) + 1), '^\\s+|\\s+$', '', 'g')) END AS BIGINT) AS body_chars
    FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> ''""")
def chapter_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("-chapter.txt")).alias("name"), F.col("text").alias("content"))
    out = segments.chapters_from_texts(named)
    return out.select(F.col("chapter_id").cast("long").alias("doc_id"), "chapter_id", "title", F.length("text").cast("long").alias("body_chars"))


@query("""
    SELECT doc_id, CAST(n - 1 AS BIGINT) AS paragraph_no, p AS text FROM (
        SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '') AS ps FROM documents))""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.paragraphs(table(spark, sf_dir, "documents"), "doc_id", separator="\n")
    return out.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "text")


@query(rf"""
    SELECT conv_id, turn, CAST(k - 1 AS BIGINT) AS sentence_no, s AS text FROM ({SENTENCES})""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = sentence_beats(spark, sf_dir)
    return beats.select("conv_id", F.floor(F.col("pos") / 10000).alias("turn"), (F.col("pos") % 10000).alias("sentence_no"), "text")


PACKED_CTES = r"""
    lines AS (
        SELECT doc_id, generate_subscripts(ps, 1) - 1 AS p, regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') AS t
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '') AS ps FROM documents)),
    cut AS (
        SELECT doc_id, p, t, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM lines WHERE length(t) > 375),
    walk AS (
        SELECT doc_id, p, ss, 1 AS i, length(ss[1]) + 1 AS size, 1 AS piece FROM cut
        UNION ALL
        SELECT doc_id, p, ss, i + 1, CASE WHEN size + 1 + length(ss[i + 1]) > 375 THEN length(ss[i + 1]) + 1 ELSE size + length(ss[i + 1]) + 1 END,
               CASE WHEN size + 1 + length(ss[i + 1]) > 375 THEN piece + 1 ELSE piece END
        FROM walk WHERE i < len(ss)),
    pieces AS (
        SELECT doc_id, p, piece, string_agg(ss[i], ' ' ORDER BY i) AS t FROM walk GROUP BY doc_id, p, piece
        UNION ALL SELECT doc_id, p, 1, t FROM lines WHERE length(t) <= 375)"""
PACKED = f"""
    WITH RECURSIVE {PACKED_CTES}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, piece) - 1 AS BIGINT) AS beat_no, CAST(p AS BIGINT) AS source_paragraph, t AS text FROM pieces"""


@query(PACKED)
def lecture_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.lecture_beats(table(spark, sf_dir, "documents"), "doc_id", separator="\n")
    return out.select("doc_id", F.col("beat_no").cast("long").alias("beat_no"), F.col("source_paragraph").cast("long").alias("source_paragraph"), "text")


@query("""
    WITH RECURSIVE parts AS (
        SELECT doc_id, generate_subscripts(ps, 1) AS p, length(unnest(ps)) + 2 AS n
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '') AS ps FROM documents)),
    held AS (SELECT doc_id, list(e ORDER BY p) AS ends FROM (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM parts) GROUP BY doc_id),
    walk AS (
        SELECT doc_id, ends, 0 AS k, 0 AS base, CAST(0 AS BIGINT) AS cut FROM held
        UNION ALL
        SELECT doc_id, ends, k + 1, cut, CAST(CASE WHEN rest <= 2600 OR n = 1 THEN n ELSE least(n, CASE WHEN hi > lo THEN lo + (hi - lo) // 2 ELSE greatest(ideal, cut + 1) END) END AS BIGINT)
        FROM (SELECT *, greatest(cut + 1, hi - 6) AS lo FROM (
              SELECT *, least(n, greatest(cut + 1, ideal - 3) + 6) AS hi FROM (
              SELECT *, coalesce((SELECT min(i) - 1 FROM range(cut + 1, n + 1) r(i) WHERE ends[i] >= b + 2000), n - 1) AS ideal FROM (
              SELECT *, len(ends) AS n, CASE WHEN cut > 0 THEN ends[cut] ELSE 0 END AS b, ends[len(ends)] - CASE WHEN cut > 0 THEN ends[cut] ELSE 0 END AS rest FROM walk WHERE cut < len(ends)))))
    )
    SELECT doc_id, CAST(k - 1 AS BIGINT) AS chunk_no, CAST(base AS BIGINT) AS base_paragraph, CAST(cut - base AS BIGINT) AS n_paragraphs,
           CAST(ends[cut] - CASE WHEN base > 0 THEN ends[base] ELSE 0 END AS BIGINT) AS chars FROM walk WHERE k > 0""")
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker with a target of 2,000 characters, so that many documents have several chunks."""
    parts = segments.paragraphs(table(spark, sf_dir, "documents"), "doc_id", separator="\n")
    out = segments.chapter_chunks(parts, "doc_id", target=2000)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "base_paragraph", "n_paragraphs", "chars")])


@query(r"""
    WITH bounds(bound_no, first, last) AS (VALUES (1, 0, 2), (2, 2, 4), (3, 6, NULL)),
    parts AS (SELECT doc_id, generate_subscripts(ps, 1) AS p, unnest(ps) AS t
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '') AS ps FROM documents)),
    ns AS (SELECT doc_id, max(p) AS n FROM parts GROUP BY doc_id),
    cl AS (SELECT doc_id, bound_no, greatest(1, least(n, first)) AS a, greatest(1, least(n, coalesce(last, n))) AS b FROM ns, bounds)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bound_no) AS BIGINT) AS scene_no, CAST(sum(length(t)) + 2 * (count(*) - 1) AS BIGINT) AS chars
    FROM cl JOIN parts USING (doc_id) WHERE p BETWEEN a AND b GROUP BY doc_id, bound_no""")
def scene_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boundaries for every document, which overlap and reach beyond its end; the last has no end."""
    parts = segments.paragraphs(table(spark, sf_dir, "documents"), "doc_id", separator="\n")
    bounds = spark.createDataFrame([(1, 0, 2), (2, 2, 4), (3, 6, None)], "bound_no int, first int, last int")
    every = parts.select("doc_id").distinct().join(F.broadcast(bounds), F.lit(True))
    out = segments.scenes(parts, every, "doc_id")
    return out.select("doc_id", F.col("scene_no").cast("long").alias("scene_no"), F.length("text").cast("long").alias("chars"))


# The corpus has no scripts, so lines of documents become headers of every shape by their numbers.
SCRIPT_LINES = r"""
    SELECT doc_id, k AS line_no, CASE WHEN k % 11 = 3 THEN '# ' || k || '. ' || line WHEN k % 11 = 5 THEN 'Scène ' || k WHEN k % 11 = 7 THEN '**' || k || '**' WHEN k % 11 = 9 THEN k || ' – ' || line WHEN k = 1 THEN '**Personnages**'
        WHEN k % 13 = 4 THEN 'The cast went home, and so did the characters.' WHEN k % 13 = 6 THEN 'Act without a number' ELSE line END AS line
    FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, unnest(string_split(text, chr(10))) AS line FROM documents)"""


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    k, line = F.col("k"), F.col("line")
    number = k.cast("string")
    shaped = (
        F.when(k % 11 == 3, F.concat(F.lit("# "), number, F.lit(". "), line)).when(k % 11 == 5, F.concat(F.lit("Scène "), number)).when(k % 11 == 7, F.concat(F.lit("**"), number, F.lit("**")))
        .when(k % 11 == 9, F.concat(number, F.lit(" – "), line)).when(k == 1, "**Personnages**").when(k % 13 == 4, "The cast went home, and so did the characters.").when(k % 13 == 6, "Act without a number").otherwise(line)
    )
    return lines.select("doc_id", k.cast("long").alias("line_no"), shaped.alias("line"))


@query(rf"""
    WITH l AS ({SCRIPT_LINES}),
    x AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS raw FROM l),
    m AS (SELECT doc_id, line_no, line, CASE WHEN line = '**Personnages**' THEN 'roster'
        WHEN regexp_matches(raw, '^#{{1,6}}\s*\d+\s*[.\\)]?\s*\S') OR regexp_matches(raw, '(?i)^\s*\**\s*(s[ée]quence|sc[èe]ne|acte?|p[ée]riode|tableau|partie)\s+[\divxlc]+')
          OR regexp_matches(raw, '^\*\*\s*\d+\s*\\?\.?\s*\*\*\s*$') OR regexp_matches(raw, '^\*{{0,2}}\s*\d+\s*[–—-]\s+\S') THEN 'scene' END AS opens FROM x),
    s AS (SELECT *, sum(CASE WHEN opens IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'preamble') AS kind FROM m)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, CAST(section_no AS BIGINT) AS section_no, kind FROM s WHERE opens IS NULL""")
def script_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a script with headers of all shapes, and lines that only look like them."""
    out = segments.script_sections(script_lines(spark, sf_dir), "doc_id")
    return out.select("doc_id", "line_no", "line", F.col("section_no").cast("long").alias("section_no"), "kind")


ITEMS = rf"""
    SELECT conv_id, CAST(turn * 10000 + k - 1 AS BIGINT) AS item_no, s AS text, CASE WHEN (k - 1) % 5 = 0 THEN 'staging' WHEN (k - 1) % 7 = 0 THEN 'cue' ELSE 'dialogue' END AS type
    FROM ({SENTENCES})"""


def script_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as items of a script: every fifth of a turn is staging, every seventh a cue."""
    beats = sentence_beats(spark, sf_dir)
    k = F.col("pos") % 10000
    kind = F.when(k % 5 == 0, "staging").when(k % 7 == 0, "cue").otherwise("dialogue")
    return beats.select("conv_id", F.col("pos").alias("item_no"), kind.alias("type"), "speaker", "text")


@query(rf"""
    WITH i AS ({ITEMS}), n AS (SELECT *, sum(CASE WHEN type = 'staging' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY item_no) AS g FROM i)
    SELECT conv_id, item_no, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY g) AS BIGINT) AS run_no FROM n WHERE type = 'dialogue'""")
def dialogue_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.dialogue_runs(script_items(spark, sf_dir), "conv_id", "item_no")
    return out.select("conv_id", "item_no", F.col("run_no").cast("long").alias("run_no"))


@query(rf"""
    WITH RECURSIVE b AS (SELECT conv_id, role, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS n FROM ({SENTENCES})),
    w AS (
        SELECT conv_id, n, role, s AS t, 0 AS g, 1 AS c FROM b WHERE n = 1
        UNION ALL
        SELECT b.conv_id, b.n, b.role,
               CASE WHEN w.role = b.role AND length(w.t) + 1 + length(b.s) <= 375 THEN trim(w.t || ' ' || b.s) ELSE b.s END,
               CASE WHEN w.role = b.role AND length(w.t) + 1 + length(b.s) <= 375 THEN w.g ELSE w.g + 1 END,
               CASE WHEN w.role = b.role AND length(w.t) + 1 + length(b.s) <= 375 THEN w.c + 1 ELSE 1 END
        FROM w JOIN b ON b.conv_id = w.conv_id AND b.n = w.n + 1)
    SELECT conv_id, CAST(g AS BIGINT) AS fused_no, max(role) AS speaker, arg_max(t, n) AS text, CAST(max(c) AS BIGINT) AS n_beats FROM w GROUP BY conv_id, g""")
def speaker_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.fused(sentence_beats(spark, sf_dir), "conv_id", "pos")
    return out.select("conv_id", F.col("fused_no").cast("long").alias("fused_no"), "speaker", "text", F.col("n_beats").cast("long").alias("n_beats"))


def _sessions_sql(speakers: int, most: int) -> str:
    close = f"((NOT list_contains(w.who, c.role) AND len(w.who) >= {speakers}) OR w.chars + length(c.text) > {most})"
    return f"""
    WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    w AS (
        SELECT conv_id, n, turn, [role] AS who, length(text) AS chars, 1 AS no FROM c WHERE n = 1
        UNION ALL
        SELECT c.conv_id, c.n, c.turn,
               CASE WHEN {close} THEN [c.role] WHEN list_contains(w.who, c.role) THEN w.who ELSE list_append(w.who, c.role) END,
               CASE WHEN {close} THEN length(c.text) ELSE w.chars + length(c.text) END,
               CASE WHEN {close} THEN w.no + 1 ELSE w.no END
        FROM w JOIN c ON c.conv_id = w.conv_id AND c.n = w.n + 1)
    SELECT conv_id, turn, CAST(no AS BIGINT) AS session_no FROM w"""


def _sessions(spark: SparkSession, sf_dir: str, speakers: int, most: int) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")
    return folds.sessions(turns, "conv_id", "turn", speakers, most)


@query(_sessions_sql(4, 3000))
def session_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, 4, 3000).select("conv_id", "turn", F.col("session_no").cast("long").alias("session_no"))


@query(_sessions_sql(2, 900))
def session_plan_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two speakers and 900 characters, so that both limits are met."""
    return _sessions(spark, sf_dir, 2, 900).select("conv_id", "turn", F.col("session_no").cast("long").alias("session_no"))


@query(rf"""
    WITH RECURSIVE p AS ({_sessions_sql(2, 900).replace('WITH RECURSIVE', 'WITH RECURSIVE')}),
    f AS (SELECT p.conv_id, p.session_no, p.turn, role, text, min(p.turn) OVER (PARTITION BY p.conv_id, p.session_no, role) AS first FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id, session_no ORDER BY first) AS k FROM f)
    SELECT conv_id, session_no, (SELECT string_agg(role, ',' ORDER BY k) FROM (SELECT DISTINCT role, k FROM r r2 WHERE r2.conv_id = r.conv_id AND r2.session_no = r.session_no)) AS speakers,
           string_agg('Speaker ' || k || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn) AS script
    FROM r GROUP BY conv_id, session_no""")
def session_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.session_scripts(_sessions(spark, sf_dir, 2, 900), "conv_id", "turn")
    return out.select("conv_id", F.col("session_no").cast("long").alias("session_no"), "speakers", "script")


@query("SELECT conv_id, turn, left(sha256(role || chr(31) || text || chr(31) || 'model-1' || chr(31)), 16) AS cache_key FROM conversations")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", content_key(F.col("role"), F.col("text"), F.lit("model-1")).alias("cache_key"))


@query(r"""
    SELECT conv_id, turn, '(' || regexp_replace(lower(regexp_replace(role || ' voice , warm', '^\s+|\s+$', '', 'g')), '\s*,\s*', ' - ', 'g') || ') "' || text || '"' AS prompt,
           coalesce(nullif(trim(regexp_replace(regexp_replace('(aside) ' || text || ' (exit)', '\([^()]*\)', ' ', 'g'), '\s+', ' ', 'g')), ''), text) AS spoken
    FROM conversations""")
def prompt_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    marked = F.concat(F.lit("(aside) "), "text", F.lit(" (exit)"))
    return turns.select("conv_id", "turn", prompt(F.concat("role", F.lit(" voice , warm")), F.col("text")).alias("prompt"), spoken_text(marked).alias("spoken"))


@query(r"""
    SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\pL\pN_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'untitled') AS slug FROM documents""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", slug(first).alias("slug"))


@query("""
    SELECT doc_id, CAST(b AS BIGINT) AS budget, CAST(60 + (b * 50) // 1000 AS BIGINT) AS timeout_s, CAST(least(((b * 3) // 2) * 3 // 2, 32768) AS BIGINT) AS after_two
    FROM (SELECT doc_id, greatest(512, least(4096, 8192 - (length(text) * 2) // 7 - 1024)) AS b FROM documents)""")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    b = token_budget(F.length("text"), F.lit(4096), context=8192)
    return docs.select("doc_id", b.alias("budget"), timeout_seconds(b).alias("timeout_s"), retry_budget(b, 2).alias("after_two"))


@query(r"""
    WITH s AS (SELECT lower(trim(regexp_replace(regexp_replace(regexp_replace(l, '\s*\([^)]*\)', '', 'g'), '[\s:.–—-]+$', ''), '\s+', ' ', 'g'))) AS stem, l, count(*) AS n, min(k) AS first
        FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' (aside)' WHEN 2 THEN upper(p_name) || ' :' ELSE p_name || ' –' END AS l FROM part) GROUP BY ALL)
    SELECT stem, arg_max(l, {'n': n, 'len': length(l), 'f': -first}) AS label, CAST(sum(n) AS BIGINT) AS uses FROM s GROUP BY stem""")
def label_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed labels of parts' names in four forms: the most frequent, then longest, then first one stands for a stem."""
    k, name = F.col("p_partkey"), F.col("p_name")
    label = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.concat(name, F.lit(" (aside)"))).when(k % 4 == 2, F.concat(F.upper(name), F.lit(" :"))).otherwise(F.concat(name, F.lit(" –")))
    labels = table(spark, sf_dir, "part").select(k.alias("k"), label.alias("label"))
    counted = labels.groupBy(label_stem(F.col("label")).alias("stem"), "label").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    return counted.groupBy("stem").agg(F.max_by("label", F.struct("n", F.length("label"), -F.col("first"))).alias("label"), F.sum("n").alias("uses"))


@query(r"""
    WITH p AS (SELECT doc_id, replace(regexp_replace(text, '\\([\\`*_{}\[\]()#+\-.!?«»])', '\1', 'g'), '**', '') AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\pL\pN_])\*([\pL\pN_])', '\1' || chr(2) || '\2', 'g'), '([\pL\pN_])\*([\pL\pN_])', '\1' || chr(2) || '\2', 'g') AS t FROM p),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([ \t\f])\*([ \t\f])', '\1' || chr(2) || '\2', 'g'), '([ \t\f])\*([ \t\f])', '\1' || chr(2) || '\2', 'g') AS t FROM a),
    d AS (SELECT doc_id, lower(trim(regexp_replace(replace(replace(t, '*', ''), chr(2), '*'), '\s+', ' ', 'g'))) AS t FROM b),
    i AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark)
    SELECT d.doc_id, CAST(i.item_id AS BIGINT) AS item_id, CASE WHEN contains(d.t, i.t) THEN 'dialogue' ELSE 'staging' END AS type FROM d, i WHERE i.t <> ''""")
def verbatim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage stays dialogue only if its source has it word for word: every passage against every document. A lone
    asterisk of a source stays between two letters or between two spaces."""
    return alignment.verbatim_types(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
