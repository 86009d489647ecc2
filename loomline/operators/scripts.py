"""Theatre scripts: speakers' labels, sample lines, and the script's own cast list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import clean_markdown, collapse, label_stem
from loomline.operators.segments import is_group_label

SAMPLES, SAMPLE_CHARS = 2, 160  # fixed
ROLE = "Speaking role."


def clean_label(x: Column) -> Column:
    """A printed label without marks, closing dashes and colons."""
    return collapse(F.regexp_replace(clean_markdown(x), r"[\s\-–:]+$", ""))


def canonical_labels(items: DataFrame, label: str = "speaker") -> DataFrame:
    """(label, canonical): labels that share a stem are one speaker, whose label is the most frequent form, then the
    longest, then the smallest."""
    forms = items.where(F.col(label) != "").select(F.col(label).alias("label"), clean_label(F.col(label)).alias("form"))
    counted = forms.groupBy("form").agg(F.count("*").alias("n")).withColumn("stem", label_stem(F.col("form")))
    # of equals the smallest: the largest of a struct can't say so
    order = Window.partitionBy("stem").orderBy(F.desc("n"), F.desc(F.length("form")), "form")
    best = counted.withColumn("r", F.row_number().over(order)).where("r = 1").select("stem", F.col("form").alias("canonical"))
    named = forms.select("label", label_stem(F.col("form")).alias("stem")).distinct()
    return named.join(best, "stem").select("label", "canonical")


def sample_lines(items: DataFrame) -> DataFrame:
    """(place, speaker, lines) of the speakers of items (item_no, type, speaker, text): in the order in which they first
    speak, with the beginnings of their first two lines. Labels of groups are left out."""
    said = items.where((F.col("type") == "dialogue") & (F.coalesce("speaker", F.lit("")) != "")).where(~is_group_label(F.col("speaker")))
    rank = F.row_number().over(Window.partitionBy("speaker").orderBy("item_no"))
    few = said.withColumn("n", rank).where(F.col("n") <= SAMPLES)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", F.left("text", F.lit(SAMPLE_CHARS)).alias("line")))), lambda x: x["line"])
    held = few.groupBy("speaker").agg(F.min("item_no").alias("first"), lines.alias("lines"))
    return held.select(F.row_number().over(Window.orderBy("first", "speaker")).cast("long").alias("place"), "speaker", "lines")


def rostered(speakers: DataFrame, roster: DataFrame) -> DataFrame:
    """speakers (speaker, ...) with bio, what the cast list (roster: name, description) says of the same stem; empty where
    it says nothing."""
    bios = roster.select(label_stem(F.col("name")).alias("__stem"), "description").groupBy("__stem").agg(F.last("description").alias("bio"))
    out = speakers.withColumn("__stem", label_stem(F.col("speaker"))).join(bios, "__stem", "left")
    return out.withColumn("bio", F.coalesce("bio", F.lit(""))).drop("__stem")


def filled_characters(speakers: DataFrame, answers: DataFrame) -> DataFrame:
    """(place, name, gender, approx_age, description) of speakers (place, speaker, bio): the names are the script's own; a
    provider's answers (name, gender, approx_age, description) fill the rest, or the cast list does."""
    held = answers.select(F.col("name").alias("speaker"), "gender", "approx_age", "description").dropDuplicates(["speaker"])
    out = speakers.join(held, "speaker", "left")
    told = F.coalesce("description", F.nullif("bio", F.lit("")), F.lit(ROLE))
    return out.select("place", F.col("speaker").alias("name"), F.coalesce("gender", F.lit("unknown")).alias("gender"), F.coalesce("approx_age", F.lit("unknown")).alias("approx_age"), told.alias("description"))
