"""Queries on voices, identities and render plans. Customers are clips, suppliers characters, parts name mentions,
events an utterance log, and line items render requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import normal_name, token_sorted, voices
from loomline.operators import castbook, casting, characters, direction, graph, identity, rendering
from loomline.operators.cut import written
from loomline.plans.registry import query, table

CLIPS = "SELECT c_custkey AS clip_id, CASE WHEN c_acctbal < 0 THEN 'female' ELSE 'male' END AS gender, c_mktsegment AS age_band, c_nationkey AS accent, c_name FROM customer"
TARGETS = "SELECT s_suppkey AS target_id, CASE WHEN s_acctbal < 3000 THEN 'female' ELSE 'male' END AS gender, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE'][1 + s_suppkey % 6] AS age_band, s_nationkey AS accent FROM supplier"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("clip_id"), F.when(F.col("c_acctbal") < 0, "female").otherwise("male").alias("gender"), F.col("c_mktsegment").alias("age_band"), F.col("c_nationkey").alias("accent"), "c_name")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")])
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("target_id"), F.when(F.col("s_acctbal") < 3000, "female").otherwise("male").alias("gender"), F.get(bands, (F.col("s_suppkey") % 6).cast("int")).alias("age_band"), F.col("s_nationkey").alias("accent"))


@query(f"""
    WITH c AS ({CLIPS}), t AS ({TARGETS}), r AS (SELECT target_id, clip_id, row_number() OVER (PARTITION BY target_id ORDER BY t.accent = c.accent DESC, clip_id) AS rank FROM t JOIN c USING (gender, age_band))
    SELECT target_id, clip_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3""")
def voice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = casting.candidates(targets(spark, sf_dir), clips(spark, sf_dir).drop("c_name"), 3)
    return out.select("target_id", "clip_id", F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH c AS ({CLIPS}), t AS ({TARGETS}),
    x AS (SELECT target_id, clip_id, CASE WHEN t.gender = c.gender AND t.age_band = c.age_band AND t.accent = c.accent THEN 1 WHEN t.gender = c.gender AND t.age_band = c.age_band THEN 2 WHEN t.gender = c.gender THEN 3 ELSE 4 END AS tier FROM t, c)
    SELECT target_id, CAST(arg_min(clip_id, CAST(tier AS BIGINT) * 1000000000 + clip_id) AS BIGINT) AS clip_id, CAST(min(tier) AS BIGINT) AS tier FROM x GROUP BY target_id""")
def fallback_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casting.fallback_tier(targets(spark, sf_dir), clips(spark, sf_dir).drop("c_name"))


@query("""
    SELECT 'Supplier ' || s_suppkey AS speaker, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey END AS clip_id, coalesce(c_name, (SELECT c_name FROM customer WHERE c_custkey = 1)) AS clip_path
    FROM supplier LEFT JOIN customer ON c_custkey = CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey END""")
def clip_path_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth speaker has no clip and gets the narrator's."""
    key = F.col("s_suppkey")
    speakers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier "), key.cast("string")).alias("speaker"), F.when(key % 4 != 0, key).alias("clip_id"))
    bank = clips(spark, sf_dir).select("clip_id", F.col("c_name").alias("clip_path"))
    return casting.clip_paths(speakers, bank, 1)


@query("""
    WITH a(alias, name, ordinal) AS (VALUES ('USER', 'Reader', 1), ('user', 'Visitor', 2), ('assistant', 'Guide', 3))
    SELECT conv_id, turn, coalesce(name, role) AS speaker, name IS NOT NULL AND name <> role AS rewritten
    FROM conversations LEFT JOIN (SELECT lower(alias) AS k, arg_max(name, ordinal) AS name FROM a GROUP BY 1) ON k = lower(trim(role))""")
def speaker_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("USER", "Reader", 1), ("user", "Visitor", 2), ("assistant", "Guide", 3)], "alias string, name string, ordinal int")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"))
    return casting.rewritten_speakers(turns, aliases)


@query(f"""
    WITH c AS ({CLIPS})
    SELECT gender, age_band, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY GROUPING SETS ((), (gender), (gender, age_band))""")
def bank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).groupingSets([[], ["gender"], ["gender", "age_band"]], "gender", "age_band").agg(F.count("*").alias("n"))


# Volumes are three groups of customers, who are named after the parts with their keys; the sought are parts' names.
VOLUMES = """
    SELECT 'v' || (1 + c_nationkey % 3) AS volume, p_name AS name, c_mktsegment AS alias, CASE WHEN c_acctbal < 0 THEN 'female' ELSE 'male' END AS gender, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS clip_id, c_custkey
    FROM customer JOIN part ON p_partkey = c_custkey"""


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    both = c.join(p, F.col("c_custkey") == F.col("p_partkey"))
    rows = both.select(F.concat(F.lit("v"), (1 + F.col("c_nationkey") % 3).cast("string")).alias("volume"), F.col("p_name").alias("name"), F.array("c_mktsegment").alias("aliases"), F.when(F.col("c_acctbal") < 0, "female").otherwise("male").alias("gender"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("clip_id"), "c_custkey")
    first = F.min_by(F.struct("aliases", "gender", "clip_id"), "c_custkey")
    return rows.groupBy("volume", "name").agg(first.alias("f")).select("volume", "name", "f.aliases", "f.gender", "f.clip_id")


@query(f"""
    WITH r AS ({VOLUMES}),
    v AS (SELECT volume, name, arg_min({{'alias': alias, 'gender': gender, 'clip_id': clip_id}}, c_custkey) AS f FROM r GROUP BY volume, name),
    a AS (SELECT volume, name, f.alias AS alias, f.gender AS gender, f.clip_id AS clip_id FROM v WHERE f.clip_id IS NOT NULL),
    k0 AS (SELECT volume, name, gender, clip_id, lower(name) AS key, 0 AS pr FROM a UNION ALL SELECT volume, name, gender, clip_id, array_to_string(list_sort(string_split(lower(name), ' ')), ' '), 1 FROM a
           UNION ALL SELECT volume, name, gender, clip_id, lower(alias), 2 FROM a),
    k AS (SELECT volume, name, gender, clip_id, key, min(pr) AS pr FROM k0 GROUP BY ALL),
    o AS (SELECT volume, key, count(DISTINCT name) AS owners, arg_min({{'c': pr < 2, 'g': gender, 'id': clip_id}}, pr) AS hit FROM k GROUP BY volume, key),
    n AS (SELECT key, arg_max(hit, volume) AS hit FROM o WHERE owners = 1 GROUP BY key),
    people AS (SELECT p_name AS name, 'female' AS gender FROM part GROUP BY p_name),
    q0 AS (SELECT name, gender, lower(name) AS key, 0 AS pr FROM people UNION ALL SELECT name, gender, array_to_string(list_sort(string_split(lower(name), ' ')), ' '), 1 FROM people),
    q AS (SELECT name, gender, key, min(pr) AS pr FROM q0 GROUP BY ALL),
    best AS (SELECT name, arg_min(hit.id, pr) AS clip_id FROM q JOIN n USING (key) WHERE hit.c OR gender = hit.g GROUP BY name)
    SELECT name, clip_id FROM people LEFT JOIN best USING (name)""")
def prior_cast_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.array().cast("array<string>").alias("aliases"), F.lit("female").alias("gender"))
    return casting.prior_casts(_volumes(spark, sf_dir), people)


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 IN (0, 1) AND event_id % 7 >= 2 AND event_id % 11 <> 0")
def utterance_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id") % 3
    log = e.select("event_id", "user_id", F.col("event_type").alias("age"), F.when(u == 0, "male").when(u == 1, "female").alias("gender"), (F.col("event_id") % 7).cast("string").alias("up_votes"), F.when(F.col("event_id") % 11 == 0, "1").otherwise("0").alias("down_votes"))
    return casting.eligible(log, ["male", "female"], ["click", "view"]).select("event_id", "user_id")


@query("""
    WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
    SELECT user_id AS client_id, event_id AS ready_at, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS rank FROM n WHERE k = 5 ORDER BY event_id LIMIT 20""")
def speaker_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty speakers with five utterances, in their order of arrival."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("at"))
    out = casting.ready_speakers(log, 5, 20)
    return out.select("client_id", "ready_at", F.col("rank").cast("long").alias("rank"))


@query("""
    WITH s AS (SELECT user_id AS client_id, event_id AS seg_no, event_id % 5 AS score, CAST(300 + event_id * 37 % 4000 AS BIGINT) AS length_ms FROM events),
    r AS (SELECT *, sum(length_ms) OVER (PARTITION BY client_id ORDER BY score DESC, seg_no) AS sum_ms FROM s WHERE length_ms >= 500),
    t AS (SELECT * FROM r WHERE sum_ms - length_ms < 12000)
    SELECT client_id, CAST(count(*) AS BIGINT) AS n_segments, CAST(sum(length_ms) AS BIGINT) AS clip_ms, arg_max(seg_no, {'a': score, 'b': -seg_no}) AS best_seg FROM t GROUP BY client_id HAVING sum(length_ms) >= 8000""")
def clip_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    segments = e.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seg_no"), (F.col("event_id") % 5).alias("score"), (300 + F.col("event_id") * 37 % 4000).alias("length_ms"))
    return casting.assembled_clips(segments)


@query("SELECT p_partkey, lower(p_name) AS norm, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS sorted FROM part")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = normal_name(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", norm.alias("norm"), token_sorted(norm).alias("sorted"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention is a brand's use of a type's name: entry_id the part, key its sorted name with its size group."""
    p = table(spark, sf_dir, "part")
    key = F.concat(F.lower("p_name"), F.lit("/"), F.col("p_brand"), F.lit("/"), (F.col("p_size") % 4).cast("string"))
    return p.select(F.col("p_partkey").alias("entry_id"), key.alias("key"))


MENTIONS = "SELECT p_partkey AS entry_id, lower(p_name) || '/' || p_brand || '/' || (p_size % 4) AS key FROM part"


@query(f"WITH m AS ({MENTIONS}) SELECT DISTINCT entry_id AS a, b FROM m JOIN (SELECT key, min(entry_id) AS b FROM m GROUP BY key) USING (key) WHERE entry_id <> b")
def exact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.exact_edges(mentions(spark, sf_dir))


# Parts as mentions: a name, and as aliases the name in capitals at its words, the brand (which names of all kinds share), a
# mere descriptor, and a pronoun. Chapters are by size.
CAST = """
    SELECT p_partkey AS entry_id, p_size % 10 AS chapter_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'male' WHEN p_partkey % 7 = 0 THEN 'female' ELSE 'unknown' END AS gender,
           CASE WHEN p_size % 2 = 0 THEN 'adult' ELSE '' END AS approx_age, p_type || ' ' || p_size AS description, p_type AS quote,
           [upper(p_name), p_brand, 'the ' || split_part(p_name, ' ', 2), 'Herself'] AS aliases FROM part"""


def cast_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    second = F.concat(F.lit("the "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return p.select(
        k.alias("entry_id"), (F.col("p_size") % 10).alias("chapter_id"), F.col("p_name").alias("name"), F.array(F.upper("p_name"), "p_brand", second, F.lit("Herself")).alias("aliases"),
        F.when(k % 3 == 0, "male").when(k % 7 == 0, "female").otherwise("unknown").alias("gender"), F.when(F.col("p_size") % 2 == 0, "adult").otherwise("").alias("approx_age"),
        F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("description"), F.array("p_type").alias("evidence"),
    )


# Names of these tables are alike if one holds the other, as no others come near a ratio of 0.9.
CLUSTERS = f"""
    m AS ({CAST}),
    k AS (SELECT DISTINCT entry_id, name, lower(unnest(list_concat([name], aliases))) AS key FROM m),
    k1 AS (SELECT * FROM k WHERE key <> 'herself'),
    base AS (SELECT key, arg_min(name, {{'l': -length(name), 'n': name}}) AS base FROM (SELECT DISTINCT key, lower(name) AS name FROM k1) GROUP BY key),
    generic AS (SELECT DISTINCT key FROM k1 JOIN base USING (key) WHERE NOT contains(base, lower(name))),
    ids AS (SELECT lower(name) AS norm, min(entry_id) AS entry_id FROM m GROUP BY 1),
    e AS (SELECT a.entry_id AS a, b.entry_id AS b FROM ids a JOIN ids b ON a.norm <> b.norm AND contains(a.norm, b.norm) AND length(a.norm) - length(b.norm) <= 3 AND 2.0 * length(b.norm) / (length(a.norm) + length(b.norm)) >= 0.9),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT entry_id AS node, entry_id AS seen FROM ids UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
    c AS (SELECT m.*, x.cluster_id FROM m JOIN ids ON norm = lower(name) JOIN (SELECT node, min(seen) AS cluster_id FROM r GROUP BY node) x ON x.node = ids.entry_id),
    n AS (SELECT cluster_id, name, count(*) AS n, min(entry_id) AS first FROM c GROUP BY ALL),
    canon AS (SELECT cluster_id, arg_max(name, {{'n': n, 'l': length(name), 'f': -first}}) AS name, string_agg(name, ',' ORDER BY first) AS members FROM n GROUP BY cluster_id),
    g AS (SELECT cluster_id, arg_max(gender, {{'n': n, 'f': -first}}) AS gender FROM (SELECT cluster_id, gender, count(*) AS n, min(entry_id) AS first FROM c WHERE gender <> 'unknown' GROUP BY ALL) GROUP BY cluster_id),
    a AS (SELECT cluster_id, count(*) FILTER (approx_age = 'adult') AS n FROM c GROUP BY cluster_id),
    al AS (SELECT cluster_id, lower(form) AS key, arg_min(form, {{'e': entry_id, 'p': p}}) AS form, min({{'e': entry_id, 'p': p}}) AS place FROM (SELECT cluster_id, entry_id, unnest(list_concat([name], aliases)) AS form, generate_subscripts(list_concat([name], aliases), 1) AS p FROM c) WHERE regexp_matches(form, '[A-Z]') AND lower(form) <> 'herself' GROUP BY ALL),
    al2 AS (SELECT cluster_id, string_agg(form, ',' ORDER BY place) AS aliases FROM al JOIN canon USING (cluster_id) WHERE key NOT IN (SELECT key FROM generic) AND key <> lower(name) GROUP BY cluster_id),
    q AS (SELECT cluster_id, quote, min(entry_id) AS first FROM c GROUP BY ALL),
    q2 AS (SELECT cluster_id, string_agg(quote, ',' ORDER BY first) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first) AS k FROM q) WHERE k <= 4 GROUP BY cluster_id),
    d AS (SELECT cluster_id, arg_max(description, {{'l': length(description), 'f': -entry_id}}) AS description, count(DISTINCT chapter_id) AS occurrences FROM c GROUP BY cluster_id),
    clusters AS (SELECT cluster_id, name, coalesce(aliases, '') AS aliases, coalesce(gender, 'unknown') AS gender, CASE WHEN a.n > 0 THEN 'adult' ELSE 'unknown' END AS approx_age, description, evidence, CAST(occurrences AS BIGINT) AS occurrences, members
        FROM canon JOIN d USING (cluster_id) JOIN q2 USING (cluster_id) JOIN a USING (cluster_id) LEFT JOIN g USING (cluster_id) LEFT JOIN al2 USING (cluster_id))"""


@query(f"WITH RECURSIVE {CLUSTERS} SELECT * FROM clusters")
def character_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clustering of mentions into characters, with all that a character has."""
    out = characters.clusters(cast_mentions(spark, sf_dir))
    return out.select(*[F.array_join(c, ",").alias(c) if c in ("aliases", "evidence", "members") else F.col(c) for c in out.columns])


@query(f"""
    WITH RECURSIVE {CLUSTERS},
    final AS (SELECT name, aliases FROM clusters WHERE cluster_id % 2 = 0 UNION ALL SELECT 'nobody at all', ''),
    fk AS (SELECT name, lower(unnest(list_concat([name], list_filter(string_split(aliases, ','), lambda x: x <> '')))) AS key FROM final),
    ck AS (SELECT name, lower(unnest(list_concat(list_concat([name], list_filter(string_split(aliases, ','), lambda x: x <> '')), string_split(members, ',')))) AS key FROM clusters)
    SELECT 'cluster' AS kind, name, CASE WHEN bool_or(key IN (SELECT key FROM fk)) THEN 'kept' ELSE 'dropped' END AS disposition FROM ck GROUP BY name
    UNION ALL SELECT 'character', name, CASE WHEN bool_or(key IN (SELECT key FROM ck)) THEN 'matched' ELSE 'new' END FROM fk GROUP BY name""")
def cluster_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the clusters in a cast of every second one of them and a stranger."""
    found = written(characters.clusters(cast_mentions(spark, sf_dir)), "clusters")
    final = found.where("cluster_id % 2 = 0").unionByName(spark.range(1).select(F.lit("nobody at all").alias("name")), allowMissingColumns=True)
    return characters.dispositions(found, final.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))))


@query("""
    WITH RECURSIVE w AS (SELECT p_partkey AS entry_id, p_size // 5 || '/' || unnest([p_name, p_type, split_part(p_name, ' ', 2) || p_partkey % 40]) AS key FROM part),
    f AS (SELECT key, min(entry_id) AS b FROM w GROUP BY key),
    e AS (SELECT DISTINCT entry_id AS a, b FROM w JOIN f USING (key) WHERE entry_id <> b),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT p_partkey AS node, p_partkey AS seen FROM part UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
    SELECT node, min(seen) AS component FROM r GROUP BY node""")
def name_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts tied by the names, types and numbered nouns that they share within a group of sizes."""
    p = table(spark, sf_dir, "part")
    noun = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), (F.col("p_partkey") % 40).cast("string"))
    size = F.concat(F.floor(F.col("p_size") / 5).cast("string"), F.lit("/"))
    keys = p.select(F.col("p_partkey").alias("entry_id"), F.explode(F.array(*[F.concat(size, x) for x in (F.col("p_name"), F.col("p_type"), noun)])).alias("key"))
    return graph.components(p.select(F.col("p_partkey").alias("node")), identity.exact_edges(keys))


@query("""
    WITH m AS (SELECT p_brand AS cluster_id, p_partkey AS entry_no, p_size % 10 AS chapter_id, p_name AS name, p_type AS description FROM part),
    n AS (SELECT cluster_id, name, count(*) AS n, min(entry_no) AS first FROM m GROUP BY ALL),
    c AS (SELECT cluster_id, arg_max(name, {'n': n, 'l': length(name), 'f': -first}) AS canonical, count(*) AS n_names FROM n GROUP BY cluster_id),
    r AS (SELECT cluster_id, arg_max(description, {'l': length(description), 'f': -entry_no}) AS description, count(DISTINCT chapter_id) AS occurrences FROM m GROUP BY cluster_id)
    SELECT cluster_id, canonical, CAST(n_names AS BIGINT) AS n_names, description, CAST(occurrences AS BIGINT) AS occurrences FROM c JOIN r USING (cluster_id)""")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    members = p.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("entry_no"), (F.col("p_size") % 10).alias("chapter_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return identity.cluster_profiles(members)


@query("""
    WITH m AS (SELECT p_brand AS k, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_type END AS v, p_partkey AS o FROM part),
    c AS (SELECT k, v, count(*) AS n, min(o) AS first FROM m WHERE v <> 'unknown' GROUP BY ALL)
    SELECT k AS cluster_id, coalesce((SELECT arg_max(v, {'n': n, 'f': -first}) FROM c WHERE c.k = m.k), 'unknown') AS gender FROM (SELECT DISTINCT k FROM m) m""")
def cluster_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("cluster_id"), F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(F.col("p_type")).alias("gender"), F.col("p_partkey").alias("o"))
    return identity.majority(rows, "cluster_id", "gender", "o")


@query("""
    WITH f AS (SELECT p_brand AS cluster_id, p_type AS quote, min(p_partkey) AS first FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first, quote) AS rank FROM f)
    SELECT cluster_id, CAST(rank AS BIGINT) AS rank, quote FROM r WHERE rank <= 4""")
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster_id"), F.col("p_type").alias("quote"), "p_partkey")
    out = identity.first_distinct(p, "cluster_id", "quote", "p_partkey")
    return out.select("cluster_id", F.col("rank").cast("long").alias("rank"), "quote")


@query()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names with a letter changed by their key, joined with what they are like."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.overlay("p_name", F.lit("x"), F.lit(2))).otherwise(F.col("p_name"))
    return identity.fuzzy_edges(p.select(F.col("p_partkey").alias("entry_id"), normal_name(name).alias("norm")))


@query("""
    WITH k AS (SELECT l_partkey, l_suppkey, min({'o': l_orderkey, 'n': l_linenumber}) AS f, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT left(sha256(l_partkey || chr(31) || l_suppkey || chr(31)), 16) AS cache_key, l_partkey, l_suppkey, f.o AS l_orderkey, CAST(f.n AS BIGINT) AS l_linenumber, CAST(n AS BIGINT) AS n_beats FROM k""")
def unique_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rendering.unique_renders(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey")
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def pending_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    need = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return rendering.pending(need, done, "l_orderkey")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def attempts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten keys with the most attempts; here the limit is the feature."""
    return rendering.attempts(table(spark, sf_dir, "events").select("user_id"), "user_id")


@query("""
    WITH n AS (SELECT c_custkey AS id, c_name AS clip FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT c_custkey AS id, 'old' AS clip FROM customer WHERE c_custkey % 2 = 0)
    SELECT id, clip FROM n UNION ALL SELECT id, clip FROM o WHERE id NOT IN (SELECT id FROM n)""")
def bank_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomline.sources import upserted

    c = table(spark, sf_dir, "customer")
    return upserted(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("clip")), c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("clip")))


@query("""
    WITH l AS (SELECT l_orderkey AS scene_id, l_linenumber AS pos, l_returnflag, l_suppkey, l_partkey, sum(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem),
    p AS (SELECT s_suppkey, 'Supplier ' || s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Voice, Nation ' || s_nationkey END AS voice FROM supplier),
    c AS (SELECT o_orderkey AS scene_id, 2 AS line_no, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority END AS cue FROM orders),
    j AS (SELECT l.scene_id, pos, l_returnflag, n, name, voice, l_partkey, c.cue FROM l LEFT JOIN p ON s_suppkey = l_suppkey LEFT JOIN c ON c.scene_id = l.scene_id AND c.line_no = n AND l_returnflag <> 'A'),
    d AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'adult, British, female, warm clear voice, measured and engaging storyteller' ELSE coalesce(voice, 'voice unknown') END || CASE WHEN trim(coalesce(cue, '')) <> '' THEN ', ' || trim(cue) ELSE '' END AS direction FROM j)
    SELECT scene_id, CAST(pos AS BIGINT) AS pos, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(n AS BIGINT) END AS line_no, CASE WHEN l_returnflag = 'A' THEN 'Narrator' ELSE name END AS speaker, direction,
           '(' || regexp_replace(lower(direction), '\\s*,\\s*', ' - ', 'g') || ') "Part ' || l_partkey || '"' AS prompt FROM d""")
def directed_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as beats: narration where they were returned, else dialogue of their supplier, whose second line of an order
    has the order's priority as its cue. Every fifth supplier has no profile."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    kind = F.when(F.col("l_returnflag") == "A", "narration").otherwise("dialogue")
    beats = li.select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").cast("long").alias("pos"), kind.alias("type"), F.concat(F.lit("Supplier "), n.cast("string")).alias("speaker"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("text"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0")
    profiles = s.select(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("Voice, Nation "), F.col("s_nationkey").cast("string")).alias("voice_descriptor"))
    cues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.lit(2).alias("line_no"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("cue"))
    return direction.directed(beats, profiles, cues).select("scene_id", "pos", "line_no", "speaker", "direction", "prompt")


BANK = "SELECT c_custkey AS clip_id, CASE WHEN c_acctbal < 0 THEN 'female' ELSE 'male' END AS gender, lower(c_mktsegment) AS age_band, ['us', 'england', 'any', 'indian', 'other'][1 + c_nationkey % 5] AS accent FROM customer"
ACCENT_SQL = "CASE accent WHEN 'us' THEN 'American, ' WHEN 'england' THEN 'British, ' WHEN 'indian' THEN 'Indian, ' ELSE '' END"
_TOLD = f"age_band || ', ' || {ACCENT_SQL} || gender || ', warm clear voice, measured and engaging storyteller'"


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    accent = F.get(F.array(*[F.lit(x) for x in ("us", "england", "any", "indian", "other")]), (F.col("c_nationkey") % 5).cast("int"))
    return c.select(F.col("c_custkey").alias("clip_id"), F.when(F.col("c_acctbal") < 0, "female").otherwise("male").alias("gender"), F.lower("c_mktsegment").alias("age_band"), accent.alias("accent"))


@query(f"""
    WITH b AS ({BANK}), p AS (SELECT s_suppkey, s_name AS name, ['N/A', 'soft, low', ' tbd ', 'Unknown', 'quick'][1 + s_suppkey % 5] AS told, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS clip_id FROM supplier)
    SELECT name, CASE WHEN lower(trim(told)) IN ('n/a', 'tbd', 'unknown') THEN CASE WHEN b.clip_id IS NULL THEN 'adult, British, female, warm clear voice, measured and engaging storyteller' ELSE {_TOLD} END ELSE told END AS voice_descriptor,
           coalesce(b.gender, 'unknown') AS gender, coalesce(b.age_band, 'adult') AS age_band, coalesce(b.accent, 'any') AS accent, p.clip_id FROM p LEFT JOIN b ON b.clip_id = p.clip_id""")
def profile_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' profiles snapped to the clips that they have, useless descriptors replaced."""
    s = table(spark, sf_dir, "supplier")
    told = F.get(F.array(*[F.lit(x) for x in ("N/A", "soft, low", " tbd ", "Unknown", "quick")]), (F.col("s_suppkey") % 5).cast("int"))
    rows = s.select(F.col("s_name").alias("name"), told.alias("voice_descriptor"), F.lit("unknown").alias("gender"), F.lit("adult").alias("age_band"), F.lit("any").alias("accent"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("clip_id"))
    return direction.snapped_profiles(rows, bank(spark, sf_dir)).select("name", "voice_descriptor", "gender", "age_band", "accent", "clip_id")


@query("""
    WITH p AS (SELECT s_name AS name, 'voice ' || s_nationkey AS voice FROM supplier), c AS (SELECT s_name AS name, s_suppkey * 7919 % 1009 AS no FROM supplier WHERE s_suppkey % 2 = 0),
    x AS (SELECT name, voice, CASE WHEN no IS NOT NULL THEN 0 ELSE 2 END AS part, coalesce(no, 0) AS no FROM p LEFT JOIN c USING (name) UNION ALL SELECT 'Narrator', 'adult, British, female, warm clear voice, measured and engaging storyteller', 3, 0)
    SELECT CAST(row_number() OVER (ORDER BY part, no, name) AS BIGINT) AS place, name, voice AS voice_descriptor FROM x""")
def profile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in the order of a cast that has every second supplier; the others, and the missing narrator, at the end."""
    s = table(spark, sf_dir, "supplier")
    profiles = s.select(F.col("s_name").alias("name"), F.concat(F.lit("voice "), F.col("s_nationkey").cast("string")).alias("voice_descriptor"))
    cast = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 7919 % 1009).alias("cast_no"))
    return direction.ordered_profiles(profiles, cast)


@query(f"""
    WITH b AS ({BANK}),
    people AS (SELECT s_name AS name, ['male', 'female', 'nonbinary', 'unknown'][1 + s_suppkey % 4] AS gender, s_suppkey AS k FROM supplier),
    prior AS (SELECT s_name AS name, k * 3 % (SELECT count(*) FROM customer) AS clip_id FROM people JOIN supplier ON s_name = name WHERE k % 3 = 0),
    rows AS (SELECT p.name, p.gender, k, b.clip_id AS prior_clip, b.gender AS g FROM people p LEFT JOIN prior USING (name) LEFT JOIN b ON b.clip_id = prior.clip_id
             UNION ALL SELECT 'Narrator', 'female', -1, NULL, NULL),
    t AS (SELECT *, CASE WHEN prior_clip IS NOT NULL AND (gender NOT IN ('male', 'female') OR gender = g) THEN 'prior' WHEN gender NOT IN ('male', 'female') THEN 'none' WHEN name = 'Narrator' THEN 'narrator' ELSE 'ranked' END AS tier FROM rows),
    c AS (SELECT t.name, arg_min(b.clip_id, {{'f': b.accent <> 'us', 'c': b.clip_id}}) AS clip_id, least(count(*), 60) AS n FROM t JOIN b ON b.gender = t.gender AND b.age_band = ['building', 'machinery', 'teen'][1 + k % 3] WHERE tier = 'ranked' GROUP BY t.name),
    l AS (SELECT arg_min(clip_id, {{'t': CASE WHEN gender = 'female' AND age_band = 'adult' AND accent = 'england' THEN 1 WHEN gender = 'female' AND age_band = 'adult' THEN 2 WHEN gender = 'female' THEN 3 ELSE 4 END, 'c': clip_id}}) AS clip_id FROM b),
    o AS (SELECT t.name, tier, CASE tier WHEN 'prior' THEN prior_clip WHEN 'narrator' THEN (SELECT clip_id FROM l) WHEN 'ranked' THEN c.clip_id END AS clip_id, coalesce(c.n, 0) AS n FROM t LEFT JOIN c ON c.name = t.name)
    SELECT o.name, o.clip_id, tier, CAST(n AS BIGINT) AS candidates, CASE WHEN o.name = 'Narrator' AND o.clip_id IS NOT NULL THEN {_TOLD} ELSE '' END AS voice_descriptor FROM o LEFT JOIN b ON b.clip_id = o.clip_id""")
def cast_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers cast from customers' clips, tier by tier, with a narrator that isn't among them."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    none = F.array().cast("array<string>")
    gender = F.get(F.array(*[F.lit(x) for x in ("male", "female", "nonbinary", "unknown")]), (k % 4).cast("int"))
    people = s.select(F.col("s_name").alias("name"), none.alias("aliases"), gender.alias("gender"), F.lit("adult").alias("approx_age"), F.lit("").alias("description"))
    n = table(spark, sf_dir, "customer").count()
    prior = s.where("s_suppkey % 3 = 0").select(F.lit("v1").alias("volume"), F.col("s_name").alias("name"), none.alias("aliases"), F.lit("unknown").alias("gender"), (k * 3 % n).alias("clip_id"))
    band = F.get(F.array(*[F.lit(x) for x in ("building", "machinery", "teen")]), (k % 3).cast("int"))
    targets = s.select(F.col("s_name").alias("name"), gender.alias("gender"), band.alias("age_band"), F.lit("us").alias("accent"))
    nobody = spark.createDataFrame([], "name string, voice_descriptor string, gender string, age_band string")
    cast = castbook.with_narrator(people, nobody, nobody, nobody)
    return castbook.cast_book(cast, bank(spark, sf_dir), prior, targets)


UTTERANCES = "SELECT user_id AS client_id, event_id AS row_no, event_id % 9 AS up, event_id % 2 AS down, event_type AS age, CASE user_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender, 'Accent ' || event_id % 4 AS accents, 'Sentence ' || event_id AS sentence FROM events"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id") % 3
    return e.select(
        F.col("user_id").alias("client_id"), k.alias("row_no"), (k % 9).cast("string").alias("up_votes"), (k % 2).cast("string").alias("down_votes"), F.col("event_type").alias("age"),
        F.when(u == 0, "male").when(u == 1, "female").alias("gender"), F.concat(F.lit("Accent "), (k % 4).cast("string")).alias("accents"), F.concat(F.lit("Sentence "), k.cast("string")).alias("sentence"),
    )


SPEAKERS = f"""
    u AS ({UTTERANCES}), r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY up - down DESC, row_no) AS k FROM u),
    speakers AS (SELECT client_id, max(age) FILTER (k = 1) AS age, max(gender) FILTER (k = 1) AS gender, max(accents) FILTER (k = 1) AS accents, CAST(count(*) AS BIGINT) AS n_utterances, string_agg(sentence, '|' ORDER BY k) FILTER (k <= 3) AS sentences FROM r GROUP BY client_id)"""


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return castbook.demographics(utterances(spark, sf_dir)).withColumn("sentences", F.array_join("sentences", "|"))


@query(f"WITH {SPEAKERS} SELECT * FROM speakers")
def speaker_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best-voted utterance of each speaker says of them."""
    return _speakers(spark, sf_dir)


@query(f"WITH {SPEAKERS} SELECT client_id, accents, n_utterances FROM speakers WHERE gender = 'female' AND contains(lower(accents), 'cent 1') AND n_utterances >= 3")
def browse_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return castbook.browsed(_speakers(spark, sf_dir), gender="female", accent="CENT 1", least=3).select("client_id", "accents", "n_utterances")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_custkey || ' ' || c_name || ' ' || c_mktsegment), '7 customer#')")
def search_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return castbook.searched(table(spark, sf_dir, "customer"), " 7 Customer#", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", "c_name")


@query("SELECT c_custkey AS client_id, c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 25")
def first_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty-five customers with money: here the limit is the feature."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), "c_mktsegment", (F.col("c_acctbal") > 0).alias("ok"))
    return castbook.first_successes(c, 25).select("client_id", "c_mktsegment")


@query(f"""
    WITH b AS ({BANK}), a AS (SELECT s_name AS name, CASE WHEN s_acctbal < 3000 THEN 'female' ELSE 'male' END AS gender, 'building' AS age_band, CASE WHEN s_suppkey % 4 = 1 THEN NULL WHEN s_suppkey % 4 = 2 THEN -s_suppkey ELSE s_suppkey END AS clip_id FROM supplier)
    SELECT name, a.clip_id, CASE WHEN b.clip_id IS NULL THEN 'missing' WHEN b.gender <> a.gender THEN 'gender' ELSE 'age' END AS conflict FROM a LEFT JOIN b ON b.clip_id = a.clip_id WHERE a.clip_id IS NOT NULL AND (b.clip_id IS NULL OR b.gender <> a.gender OR b.age_band <> a.age_band)""")
def assignment_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    given = s.select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 3000, "female").otherwise("male").alias("gender"), F.lit("building").alias("age_band"), F.when(k % 4 == 1, None).when(k % 4 == 2, -k).otherwise(k).alias("clip_id"))
    return castbook.assignment_conflicts(given, bank(spark, sf_dir))


DESCRIPTORS = "SELECT p_partkey, p_name || ', ' || ['woman in her thirties', 'a KID', 'middle-aged', 'teenage soprano', 'girlish', 'mid-20s'][1 + p_size % 6] AS d FROM part"


@query(f"""
    WITH x AS ({DESCRIPTORS})
    SELECT p_partkey, CASE WHEN regexp_matches(d, '(?i)\\b(female|woman|girl|soprano|alto|mezzo)\\b') THEN 'female' ELSE 'male' END AS gender,
           CASE WHEN regexp_matches(d, '(?i)\\b(teen|teenage|teenager)\\b') THEN 'teen' WHEN regexp_matches(d, '(?i)\\b(child|kid|young child)\\b') THEN 'child' WHEN regexp_matches(d, '(?i)\\b(elder|elderly|old|sixties|seventies|eighties|nineties)\\b') THEN 'elder'
                WHEN regexp_matches(d, '(?i)\\b(young adult|twenties|thirties|mid-?20s|mid-?30s|mid-thirties|mid-twenties)\\b') THEN 'young_adult' ELSE 'adult' END AS age_band FROM x""")
def descriptor_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gender and age that words of a descriptor tell."""
    words = F.get(F.array(*[F.lit(x) for x in ("woman in her thirties", "a KID", "middle-aged", "teenage soprano", "girlish", "mid-20s")]), (F.col("p_size") % 6).cast("int"))
    d = F.concat_ws(", ", "p_name", words)
    return table(spark, sf_dir, "part").select("p_partkey", voices.gender_in(d).alias("gender"), voices.age_in(d).alias("age_band"))


@query(f"WITH b AS ({BANK}) SELECT clip_id, {_TOLD} AS descriptor FROM b")
def clip_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).select("clip_id", voices.clip_descriptor(F.col("age_band"), F.col("accent"), F.col("gender")).alias("descriptor"))
