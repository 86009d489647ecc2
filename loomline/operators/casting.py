"""Voices for characters: lookups with fallbacks, candidates, tiers, prior casts, and utterances for clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import normal_name, token_sorted


def clip_paths(speakers: DataFrame, clips: DataFrame, fallback_id: str | None = None) -> DataFrame:
    """speakers (speaker, clip_id) with clip_path: null where none is assigned (or the fallback's), an error where the
    assigned one isn't in the bank."""
    found = speakers.join(clips.select(F.col("clip_id"), F.col("clip_path")), "clip_id", "left")
    missing = F.raise_error(F.concat(F.lit("no such clip: "), F.col("clip_id")))
    path = F.when(F.col("clip_id").isNotNull() & F.col("clip_path").isNull(), missing.cast("string")).otherwise(F.col("clip_path"))
    if fallback_id is not None:
        narrator = clips.where(F.col("clip_id") == fallback_id).select(F.col("clip_path").alias("__narrator")).limit(1)
        found = found.join(F.broadcast(narrator), F.lit(True), "left")
        path = F.coalesce(path, F.col("__narrator"))
    return found.select("speaker", "clip_id", path.alias("clip_path"))


def rewritten_speakers(beats: DataFrame, aliases: DataFrame) -> DataFrame:
    """beats with speaker replaced by its canonical name, and whether it was: aliases (alias, name, ordinal), of which
    the last one for an alias wins. Unknown speakers stay."""
    held = aliases.groupBy(normal_name(F.col("alias")).alias("__key")).agg(F.max_by("name", "ordinal").alias("__name"))
    found = beats.withColumn("__key", normal_name(F.col("speaker"))).join(held, "__key", "left")
    name = F.coalesce("__name", "speaker")
    return found.withColumn("rewritten", F.coalesce(name != F.col("speaker"), F.lit(False))).withColumn("speaker", name).drop("__key", "__name")


def candidates(targets: DataFrame, clips: DataFrame, most: int = 60) -> DataFrame:
    """targets (target_id, gender, age_band, accent) with their best clips (clip_id, gender, age_band, accent) by rank:
    gender and age have to agree; those of the accent come first, then by clip_id.

    No target needs more than the first clips of its gender, age and accent, and of its gender and age: these are ranked
    before the join, so a target meets at most twice as many clips as it keeps."""
    def best(*keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("clip_id"))
        return clips.withColumn("__n", rank).where(F.col("__n") <= most).select(*keys, "clip_id")

    own = targets.join(best("gender", "age_band", "accent"), ["gender", "age_band", "accent"]).select("target_id", "clip_id", F.lit(0).alias("far"))
    any_ = targets.select("target_id", "gender", "age_band").join(best("gender", "age_band"), ["gender", "age_band"]).select("target_id", "clip_id", F.lit(1).alias("far"))
    both = own.unionByName(any_).groupBy("target_id", "clip_id").agg(F.min("far").alias("far"))
    order = Window.partitionBy("target_id").orderBy("far", "clip_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("target_id", "clip_id", "rank")


def fallback_tier(targets: DataFrame, clips: DataFrame) -> DataFrame:
    """The first clip of the best tier for each target: gender and age (its accent first), then gender, then any."""
    def lowest(*keys: str) -> DataFrame:
        best = F.min("clip_id")
        return clips.groupBy(*keys).agg(best.alias("clip")) if keys else clips.agg(best.alias("clip"))

    out = targets
    for tier, keys in enumerate((("gender", "age_band", "accent"), ("gender", "age_band"), ("gender",)), 1):
        out = out.join(lowest(*keys).withColumnRenamed("clip", f"clip{tier}"), list(keys), "left")
    out = out.join(F.broadcast(lowest().withColumnRenamed("clip", "clip4")), F.lit(True), "left")
    tier = F.coalesce(*[F.when(F.col(f"clip{k}").isNotNull(), k) for k in range(1, 5)])
    return out.select("target_id", F.coalesce("clip1", "clip2", "clip3", "clip4").alias("clip_id"), tier.cast("long").alias("tier"))


def identity_keys(people: DataFrame, *keep: str) -> DataFrame:
    """Keys of people (name, aliases) in their order: the name and its sorted form (canonical), then each alias's two."""
    def both(x: Column, i, canonical: bool):
        n = normal_name(x)
        return F.array(F.struct((i * 2).cast("int").alias("priority"), n.alias("key"), F.lit(canonical).alias("canonical")), F.struct((i * 2 + 1).cast("int").alias("priority"), token_sorted(n).alias("key"), F.lit(canonical).alias("canonical")))

    own = both(F.col("name"), F.lit(0), True)
    others = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a, i: both(a, i + 1, False)))
    found = people.select(*keep, F.explode(F.concat(own, others)).alias("k")).select(*keep, "k.*").where("key <> ''")
    first = F.min_by(F.struct("priority", "canonical"), "priority")
    return found.groupBy(*keep, "key").agg(first.alias("f")).select(*keep, "key", "f.priority", "f.canonical")


def prior_casts(volumes: DataFrame, people: DataFrame) -> DataFrame:
    """people (name, aliases, gender) with clip_id of their casting in earlier volumes (volume, name, aliases, gender,
    clip_id), or null.

    A volume's key that two of its names claim is dropped from that volume; unassigned castings don't count; the newest
    volume wins for each key. A hit by two canonical keys is trusted; any other needs the same known gender, and else
    the next key is tried."""
    assigned = volumes.where("clip_id is not null")
    keys = identity_keys(assigned, "volume", "name", "gender", "clip_id")
    owners = keys.groupBy("volume", "key").agg(F.count_distinct("name").alias("owners"), F.min_by(F.struct("canonical", "gender", "clip_id"), "priority").alias("hit"))
    newest = owners.where("owners = 1").groupBy("key").agg(F.max_by("hit", "volume").alias("hit"))
    asked = identity_keys(people, "name", "gender")
    found = asked.join(newest, "key")
    trusted = (F.col("canonical") & F.col("hit.canonical")) | (F.col("gender").isin("male", "female") & (F.col("gender") == F.col("hit.gender")))
    best = found.where(trusted).groupBy("name").agg(F.min_by("hit.clip_id", "priority").alias("clip_id"))
    return people.select("name").join(best, "name", "left")


def eligible(utterances: DataFrame, genders: list[str], ages: list[str]) -> DataFrame:
    """Utterances with a known gender and age, at least two votes up and none down; votes that are no numbers fail."""
    up, down = F.expr("try_cast(up_votes as int)"), F.expr("try_cast(down_votes as int)")
    return utterances.where(F.col("gender").isin(genders) & F.col("age").isin(ages) & (up >= 2) & (down == 0))


def ready_speakers(utterances: DataFrame, least: int, most: int) -> DataFrame:
    """Speakers in the order in which they reach so many utterances (client_id, at), and at most so many of them."""
    nth = F.row_number().over(Window.partitionBy("client_id").orderBy("at"))
    ready = utterances.withColumn("nth", nth).where(F.col("nth") == least).select("client_id", F.col("at").alias("ready_at"))
    # the limit runs as a top-k of every partition before rows meet
    top = ready.orderBy("ready_at", "client_id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("ready_at", "client_id")))


def assembled_clips(segments: DataFrame, target_ms: int = 12_000, least_ms: int = 8_000, shortest_ms: int = 500) -> DataFrame:
    """Per client, the segments (client_id, seg_no, score, length_ms) that make up its clip: best scores first, short
    ones skipped, until the target is reached; clients below the least length are rejected."""
    order = Window.partitionBy("client_id").orderBy(F.desc("score"), "seg_no")
    run = segments.where(F.col("length_ms") >= shortest_ms).withColumn("sum_ms", F.sum("length_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = run.where(F.col("sum_ms") - F.col("length_ms") < target_ms)
    clip = taken.groupBy("client_id").agg(F.count("*").alias("n_segments"), F.sum("length_ms").alias("clip_ms"), F.max_by("seg_no", F.struct("score", -F.col("seg_no"))).alias("best_seg"))
    return clip.where(F.col("clip_ms") >= least_ms)
