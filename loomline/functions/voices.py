"""Expressions on voices: what a descriptor tells of a speaker, what a clip's descriptor says, and corpus codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by which descriptors tell gender and age, the first of these that is there.
FEMALE = r"(?i)\b(?:female|woman|girl|soprano|alto|mezzo)\b"
AGES = (
    ("teen", r"(?i)\b(?:teen|teenage|teenager)\b"),
    ("child", r"(?i)\b(?:child|kid|young child)\b"),
    ("elder", r"(?i)\b(?:elder|elderly|old|sixties|seventies|eighties|nineties)\b"),
    ("young_adult", r"(?i)\b(?:young adult|twenties|thirties|mid-?20s|mid-?30s|mid-thirties|mid-twenties)\b"),
    ("adult", r"(?i)\b(?:adult|middle-?aged|fourties|forties|fifties)\b"),
)
# Codes of a public speech corpus, and what they count as.
AGE_BANDS = {
    "teens": "teen", "twenties": "young_adult", "thirties": "young_adult", "fourties": "adult", "fifties": "adult",
    "sixties": "elder", "seventies": "elder", "eighties": "elder", "nineties": "elder",
}
GENDERS = {"male_masculine": "male", "female_feminine": "female"}
ACCENT_CODES = {
    "United States English": "us",
    "England English": "england",
    "India and South Asia (India, Pakistan, Sri Lanka)": "indian",
    "Canadian English": "canada",
    "Australian English": "australia",
    "Scottish English": "scotland",
    "Southern African (South Africa, Zimbabwe, Namibia)": "african",
    "New Zealand English": "newzealand",
    "Irish English": "ireland",
    "Filipino": "philippines",
    "Hong Kong English": "hongkong",
    "Singaporean English": "singapore",
    "Malaysian English": "malaysia",
    "Welsh English": "wales",
    "West Indies and Bermuda (Bahamas, Bermuda, Jamaica, Trinidad)": "bermuda",
    "South Atlantic (Falkland Islands, Saint Helena)": "southatlandtic",
}
ACCENT_WORDS = {
    "us": "American", "england": "British", "scotland": "Scottish", "wales": "Welsh", "ireland": "Irish", "australia": "Australian",
    "canada": "Canadian", "indian": "Indian", "newzealand": "New Zealand", "african": "African", "philippines": "Filipino",
    "hongkong": "Hong Kong", "singapore": "Singaporean", "malaysia": "Malaysian", "bermuda": "West Indian",
}
NARRATOR = "Narrator"
NARRATOR_GENDER, NARRATOR_AGE, NARRATOR_ACCENT = "female", "adult", "england"  # fixed: of a narrator nobody chose
NARRATOR_TAIL = "warm clear voice, measured and engaging storyteller"
NO_DESCRIPTOR = ["", "n/a", "na", "unknown", "none", "tbd"]  # fixed: descriptors that say nothing


def _map(codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def gender_in(descriptor: Column) -> Column:
    """female where a word says so, else male."""
    return F.when(descriptor.rlike(FEMALE), "female").otherwise("male")


def age_in(descriptor: Column) -> Column:
    """The first age band that a word of the descriptor tells, in a fixed order; adult where none does."""
    return F.coalesce(*[F.when(descriptor.rlike(words), band) for band, words in AGES], F.lit("adult"))


def age_band(code: Column) -> Column:
    """The age band of a corpus code; null for others."""
    return F.try_element_at(_map(AGE_BANDS), code)


def gender_of(code: Column) -> Column:
    return F.try_element_at(_map(GENDERS), code)


def accents(x: Column) -> Column:
    """The code of the first of a corpus entry's accents: any where there is none, other for an unknown one."""
    first = F.trim(F.split_part(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(1)))
    return F.when(first == "", "any").otherwise(F.coalesce(F.try_element_at(_map(ACCENT_CODES), first), F.lit("other")))


def clip_descriptor(age: Column, accent: Column, gender: Column, tail: str | Column = NARRATOR_TAIL) -> Column:
    """A descriptor of a clip's data alone: age, accent where it has a word, gender and how it speaks."""
    tail = F.lit(tail) if isinstance(tail, str) else tail
    return F.concat_ws(", ", F.translate(age, "_", " "), F.try_element_at(_map(ACCENT_WORDS), accent), F.when(gender == "female", "female").otherwise("male"), tail)


def useless_descriptor(descriptor: Column) -> Column:
    """Whether a descriptor says nothing."""
    return F.lower(F.trim(F.coalesce(descriptor, F.lit("")))).isin(*NO_DESCRIPTOR)
