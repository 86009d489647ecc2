"""A book's cast of voices, tier by tier, and browsing a corpus for clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.voices import NARRATOR, NARRATOR_ACCENT, NARRATOR_AGE, NARRATOR_GENDER, age_in, clip_descriptor, gender_in
from loomline.operators import casting

CANDIDATES, CHOICES = 60, 3  # fixed: clips that are considered, and that are ranked


def with_narrator(people: DataFrame, override: DataFrame, prior: DataFrame, profiles: DataFrame) -> DataFrame:
    """people (name, aliases, gender, approx_age, description) with a narrator where there is none. What is known of it
    comes from the first of: the clip chosen for it (override: gender, age_band), its casting in an earlier volume
    (prior: gender, age_band), its profile (profiles: name, voice_descriptor), the default."""
    one = people.sparkSession.range(1).select(F.lit(NARRATOR).alias("name"))

    def first(df: DataFrame, name: str, *values: Column) -> DataFrame:
        # one row at most, beside the one row that there always is
        return df.limit(1).select(F.struct(*values).alias(name))

    rows = one.join(F.broadcast(first(override, "o", F.col("gender"), F.col("age_band"))), F.lit(True), "left")
    rows = rows.join(F.broadcast(first(prior, "v", F.col("gender"), F.col("age_band"))), F.lit(True), "left")
    said = profiles.where(F.col("name") == NARRATOR).select("voice_descriptor")
    rows = rows.join(F.broadcast(first(said, "p", F.col("voice_descriptor"))), F.lit(True), "left")
    words = F.col("p.voice_descriptor")
    by_profile = F.col("o").isNull() & F.col("v").isNull() & F.col("p").isNotNull()
    gender = F.when(F.col("o").isNotNull(), F.col("o.gender")).when(F.col("v").isNotNull(), F.coalesce(F.nullif("v.gender", F.lit("")), F.lit(NARRATOR_GENDER))).when(by_profile, gender_in(words)).otherwise(NARRATOR_GENDER)
    age = F.when(F.col("o").isNotNull(), F.col("o.age_band")).when(F.col("v").isNotNull(), F.coalesce(F.nullif("v.age_band", F.lit("")), F.lit(NARRATOR_AGE))).when(by_profile, age_in(words)).otherwise(NARRATOR_AGE)
    told = F.when(by_profile, words).otherwise("A neutral narrator.")
    made = rows.select("name", F.array().cast("array<string>").alias("aliases"), gender.alias("gender"), age.alias("approx_age"), told.alias("description"))
    missing = made.join(people.where(F.col("name") == NARRATOR).select("name"), "name", "left_anti")
    return people.select("name", "aliases", "gender", "approx_age", "description").unionByName(missing)


def cast_book(people: DataFrame, clips: DataFrame, prior: DataFrame, targets: DataFrame, narrator_clip=None) -> DataFrame:
    """(name, clip_id, tier, candidates, voice_descriptor) for people (name, aliases, gender) with a narrator among them.

    Tiers: override, the narrator's chosen clip, which has to be in the bank; prior, the clip of an earlier volume (prior:
    volume, name, aliases, gender, clip_id) that is in the bank and doesn't contradict the genders that are known; none,
    for genders that the bank doesn't cover; narrator, by a ladder of ever wider sets of clips; ranked, the best clip of a
    character's target (targets: name, gender, age_band, accent), its accent first. Whoever has no clip has a null one.
    clips: clip_id, gender, age_band, accent."""
    spark = people.sparkSession
    known = clips.select("clip_id", F.col("gender").alias("clip_gender"), "age_band", "accent")
    if narrator_clip is not None and clips.where(F.col("clip_id") == narrator_clip).isEmpty():
        raise ValueError(f"no such clip: {narrator_clip}")
    found = casting.prior_casts(prior, people).withColumnRenamed("clip_id", "prior_clip")
    owner = prior.where("clip_id is not null").groupBy("clip_id").agg(F.collect_set("gender").alias("prior_genders")).withColumnRenamed("clip_id", "prior_clip")
    rows = people.select("name", "gender").join(found, "name", "left").join(owner, "prior_clip", "left")
    rows = rows.join(known.select(F.col("clip_id").alias("prior_clip"), F.col("clip_gender")), "prior_clip", "left")
    genders = F.array_intersect(F.concat(F.array("gender"), F.coalesce("prior_genders", F.array().cast("array<string>"))), F.array(F.lit("male"), F.lit("female")))
    agrees = (F.size(genders) == 0) | F.array_contains(genders, F.col("clip_gender"))
    is_narrator = F.col("name") == NARRATOR
    tier = (
        F.when(is_narrator & F.lit(narrator_clip is not None), "override")
        .when(F.col("clip_gender").isNotNull() & agrees, "prior")
        .when(~F.coalesce(F.col("gender").isin("male", "female"), F.lit(False)), "none")
        .when(is_narrator, "narrator")
        .otherwise("ranked")
    )
    rows = rows.withColumn("tier", tier)
    default = spark.createDataFrame([(NARRATOR, NARRATOR_GENDER, NARRATOR_AGE, NARRATOR_ACCENT)], "target_id string, gender string, age_band string, accent string")
    ladder = casting.fallback_tier(default, clips.select("clip_id", "gender", "age_band", "accent")).select(F.col("target_id").alias("name"), F.col("clip_id").alias("ladder_clip"))
    asked = targets.join(rows.where("tier = 'ranked'").select("name"), "name", "left_semi").select(F.col("name").alias("target_id"), "gender", "age_band", "accent")
    best = casting.candidates(asked, clips.select("clip_id", "gender", "age_band", "accent"), CANDIDATES)
    best = best.groupBy(F.col("target_id").alias("name")).agg(F.min_by("clip_id", "rank").alias("best_clip"), F.count("*").alias("n"))
    out = rows.join(ladder, "name", "left").join(best, "name", "left")
    chosen = F.when(F.col("tier") == "override", F.lit(narrator_clip)).when(F.col("tier") == "prior", F.col("prior_clip")).when(F.col("tier") == "narrator", F.col("ladder_clip")).when(F.col("tier") == "ranked", F.col("best_clip"))
    out = out.select("name", chosen.alias("clip_id"), "tier", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))
    out = out.join(known, "clip_id", "left")
    told = F.when((F.col("name") == NARRATOR) & F.col("clip_id").isNotNull(), clip_descriptor(F.col("age_band"), F.col("accent"), F.col("clip_gender"))).otherwise("")
    return out.select("name", "clip_id", "tier", "candidates", told.alias("voice_descriptor"))


def demographics(utterances: DataFrame) -> DataFrame:
    """One row a speaker of utterances (client_id, row_no, up_votes, down_votes, age, gender, accents, sentence): what the
    best-voted one says of the speaker, how many there are, and up to three sentences, best first."""
    score = F.col("up_votes").cast("long") - F.col("down_votes").cast("long")
    # the best vote, then the first row
    rank = F.struct((-score).alias("s"), F.col("row_no").alias("r"))
    ranked = utterances.withColumn("__n", F.row_number().over(Window.partitionBy("client_id").orderBy(rank)))
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= 3, F.struct("__n", "sentence")))), lambda x: x["sentence"])
    best = {c: F.min_by(c, "__n").alias(c) for c in ("age", "gender", "accents")}
    return ranked.groupBy("client_id").agg(*best.values(), F.count("*").alias("n_utterances"), said.alias("sentences"))


def browsed(speakers: DataFrame, gender: str = "", age: str = "", accent: str = "", least: int = 0) -> DataFrame:
    """Speakers (gender, age, accents, n_utterances) that meet every filter that is set; accents match by a part."""
    out = speakers
    if gender:
        out = out.where(F.col("gender") == gender)
    if age:
        out = out.where(F.col("age") == age)
    if accent:
        out = out.where(F.contains(F.lower(F.coalesce("accents", F.lit(""))), F.lit(accent.lower())))
    return out.where(F.col("n_utterances") >= least) if least else out


def searched(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in whose columns, joined by spaces, the needle stands, without regard to case; all rows for a blank one."""
    needle = needle.strip().lower()
    if not needle:
        return rows
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns or rows.columns])), F.lit(needle)))


def first_successes(clips: DataFrame, most: int, key: str = "client_id", succeeded: str = "ok") -> DataFrame:
    """The first so many rows by key that succeeded: failures don't count. A limit over a sort, a top-k of each partition."""
    return clips.where(F.col(succeeded)).orderBy(key).limit(most)


def stored_clip(bank: DataFrame, clip: DataFrame) -> DataFrame:
    """bank with a clip added by hand: an id that is taken is an error."""
    taken = [r.id for r in clip.select("id").join(bank.select("id"), "id", "left_semi").limit(1).collect()]
    if taken:
        raise ValueError(f"the bank has a clip {taken[0]}")
    return bank.unionByName(clip)


def assignment_conflicts(assigned: DataFrame, clips: DataFrame) -> DataFrame:
    """(name, clip_id, conflict) of assigned (name, gender, age_band, clip_id): what has to be confirmed, since the clip
    (clip_id, gender, age_band) is of another gender or age, or isn't in the bank."""
    held = clips.select("clip_id", F.col("gender").alias("g"), F.col("age_band").alias("a"))
    what = F.when(F.col("g").isNull() & F.col("a").isNull(), "missing").when(F.col("g") != F.col("gender"), "gender").when(F.col("a") != F.col("age_band"), "age")
    return assigned.where("clip_id is not null").join(held, "clip_id", "left").select("name", "clip_id", what.alias("conflict")).where("conflict is not null")
