"""How lines are to be spoken: profiles of voices, descriptors and cues for beats, and speech normalisation in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import prompt, strip
from loomline.functions.voices import NARRATOR, clip_descriptor, useless_descriptor

NARRATOR_DESCRIPTOR = "adult, British, female, warm clear voice, measured and engaging storyteller"  # fixed: where nothing is known
UNKNOWN_SPEAKER, UNKNOWN_VOICE = "Unknown", "voice unknown"  # fixed
BATCH = 25  # fixed: passages of one call


def snapped_profiles(profiles: DataFrame, clips: DataFrame) -> DataFrame:
    """profiles (name, voice_descriptor, gender, age_band, accent, clip_id) with what the assigned clip (clip_id, gender,
    age_band, accent) says of gender, age and accent, and with a descriptor where there is a useless one: the clip's, else
    the narrator's. Profiles without a clip keep their own data."""
    held = clips.select("clip_id", *[F.col(c).alias(f"__{c}") for c in ("gender", "age_band", "accent")], F.lit(True).alias("__there"))
    both = profiles.join(held, "clip_id", "left")
    own = F.when(F.col("__there"), clip_descriptor(F.col("__age_band"), F.col("__accent"), F.col("__gender"))).otherwise(NARRATOR_DESCRIPTOR)
    descriptor = F.when(useless_descriptor(F.col("voice_descriptor")), own).otherwise(strip(F.col("voice_descriptor")))
    kept = [F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("gender", "age_band", "accent")]
    return both.select("name", descriptor.alias("voice_descriptor"), *kept, "clip_id")


def ordered_profiles(profiles: DataFrame, cast: DataFrame) -> DataFrame:
    """(place, name, voice_descriptor) of profiles (name, voice_descriptor) in the order of cast (cast_no, name): those in
    the cast, then the narrator, then all others by name. Without a narrator's profile one is added. Cast members without
    a profile have none."""
    known = profiles.groupBy("name").agg(F.first("voice_descriptor").alias("voice_descriptor"))
    narrator = profiles.sparkSession.createDataFrame([(NARRATOR, NARRATOR_DESCRIPTOR)], "name string, __default string")
    held = known.join(narrator, "name", "full_outer")
    held = held.join(cast.groupBy("name").agg(F.min("cast_no").alias("cast_no")), "name", "left")
    stub = F.col("voice_descriptor").isNull()
    part = F.when(stub, 3).when(F.col("cast_no").isNotNull(), 0).when(F.col("name") == NARRATOR, 1).otherwise(2)
    order = F.struct(part.alias("part"), F.coalesce("cast_no", F.lit(0)).alias("cast_no"), "name")
    place = F.row_number().over(Window.orderBy("order"))  # a row a voice: a cast fits one task
    return held.withColumn("order", order).select(place.cast("long").alias("place"), "name", F.coalesce("voice_descriptor", "__default").alias("voice_descriptor"))


def directed(beats: DataFrame, profiles: DataFrame, cues: DataFrame) -> DataFrame:
    """beats (scene_id, pos, type, speaker, text) with line_no (dialogue only), direction and prompt.

    Narration has the narrator's descriptor; dialogue its speaker's, and the cue of its number in the scene, if cues
    (scene_id, line_no, cue) has one that isn't blank. A speaker without a profile has an unknown voice, and a dialogue
    without a speaker an unknown one."""
    talk = F.col("type") != "narration"
    number = F.sum(F.when(talk, 1).otherwise(0)).over(Window.partitionBy("scene_id").orderBy("pos"))
    rows = beats.withColumn("line_no", F.when(talk, number.cast("long")))
    rows = rows.withColumn("speaker", F.when(~talk, NARRATOR).otherwise(F.coalesce(F.nullif("speaker", F.lit("")), F.lit(UNKNOWN_SPEAKER))))
    held = profiles.select(F.col("name").alias("speaker"), F.col("voice_descriptor").alias("__descriptor"))
    asked = cues.select("scene_id", F.col("line_no").cast("long").alias("line_no"), strip(F.col("cue")).alias("__cue")).dropDuplicates(["scene_id", "line_no"])
    rows = rows.join(held, "speaker", "left").join(asked, ["scene_id", "line_no"], "left")
    descriptor = F.coalesce("__descriptor", F.when(talk, UNKNOWN_VOICE).otherwise(NARRATOR_DESCRIPTOR))
    direction = F.when(F.coalesce("__cue", F.lit("")) != "", F.concat(descriptor, F.lit(", "), F.col("__cue"))).otherwise(descriptor)
    return rows.withColumn("direction", direction).withColumn("prompt", prompt(F.col("direction"), F.col("text"))).drop("__descriptor", "__cue")


def positional(directed_beats: DataFrame, rendered: DataFrame, key: str = "chapter_id", order: str = "pos") -> DataFrame:
    """directed_beats (key, order, ...) with duration_ms of rendered (key, order, duration_ms): the n-th with the n-th of
    its chapter. A chapter whose counts differ is an error."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    left = directed_beats.withColumn("__n", place)
    right = rendered.withColumn("__n", place).select(F.col(key), "__n", F.col("duration_ms").alias("__ms"), F.lit(True).alias("__there"))
    both = left.withColumn("__here", F.lit(True)).join(right, [key, "__n"], "full_outer")
    wrong = F.raise_error(F.concat(F.lit("beats and renders differ in "), F.col(key).cast("string"))).cast("long")
    return both.withColumn("duration_ms", F.when(F.col("__here") & F.col("__there"), F.col("__ms")).otherwise(wrong)).drop("__n", "__ms", "__there", "__here")


def batches(beats: DataFrame, key: str, order: str, size: int = BATCH) -> DataFrame:
    """(key, batch_no, passages, chars) of beats (key, order, source_span): the prompt lines "[i] span" of each call."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = beats.select(key, (F.floor(place / size)).cast("long").alias("batch_no"), (place % size).alias("i"), F.coalesce("source_span", F.lit("")).alias("span"))
    line = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.col("span"))
    lines = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    return rows.groupBy(key, "batch_no").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("passages"), F.sum(F.length("span")).cast("long").alias("chars"))


def normalised(beats: DataFrame, answers: DataFrame, key: str, order: str, size: int = BATCH) -> DataFrame:
    """beats (key, order, text, ...) with the text of answers (key, batch_no, i, text) where there is one that isn't blank;
    all others, and with them batches that failed, stay word for word. Of several answers for one index the last counts."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = beats.withColumn("batch_no", F.floor(place / size).cast("long")).withColumn("i", (place % size).cast("long"))
    held = answers.select(key, F.col("batch_no").cast("long").alias("batch_no"), F.col("i").cast("long").alias("i"), strip(F.col("text")).alias("__spoken"))
    held = held.groupBy(key, "batch_no", "i").agg(F.last("__spoken").alias("__spoken"))
    out = rows.join(held, [key, "batch_no", "i"], "left").withColumn("text", F.coalesce(F.nullif("__spoken", F.lit("")), F.col("text")))
    return out.drop("batch_no", "i", "__spoken")
