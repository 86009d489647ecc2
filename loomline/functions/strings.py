"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"  # fixed: ends each part of a content key


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normal_name(x: Column) -> Column:
    """Lower case, collapsed: what names are compared by."""
    return collapse(F.lower(x))


def token_sorted(x: Column) -> Column:
    """A name's words in order, so that "B A" and "A B" are one key."""
    return F.array_join(F.array_sort(F.split(x, " ")), " ")


def digit_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(\d+)"))


def content_key(*parts: Column) -> Column:
    """16 hexadecimal digits that name the parts; every part is ended by a separator."""
    ended = [p for part in parts for p in (part, F.lit(SEPARATOR))]
    return F.left(F.sha2(F.concat(*ended).cast("binary"), 256), F.lit(16))


def slug(x: Column, most: int = 80, fallback: str = "untitled") -> Column:
    """Lower-case words joined by hyphens, at most so many characters: marks go, white space and underscores are hyphens."""
    words = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s-]", ""), r"[\s_-]+", "-")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(words, r"^-+|-+$", ""), F.lit(most)), F.lit("")), F.lit(fallback))


def prompt(direction: Column, text: Column) -> Column:
    """(direction) "text", the direction lower-cased with its commas as dashes; the bare quote without a direction."""
    tidy = F.regexp_replace(F.lower(strip(direction)), r"\s*,\s*", " - ")
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(F.coalesce(tidy, F.lit("")) == "", quoted).otherwise(F.concat(F.lit("("), tidy, F.lit(") "), quoted))


def spoken_text(x: Column) -> Column:
    """Without innermost parentheticals, collapsed; unchanged where nothing else would be left."""
    return F.coalesce(F.nullif(collapse(F.regexp_replace(x, r"\([^()]*\)", " ")), F.lit("")), x)


def clean_markdown(x: Column) -> Column:
    """Backslash escapes resolved, bold and emphasis marks gone, stripped. A lone asterisk between white space or inside
    a word stays."""
    plain = F.regexp_replace(F.regexp_replace(x, r"\\([\\`*_{}\[\]()#+\-.!?«»])", "$1"), r"\*\*", "")
    return strip(F.regexp_replace(plain, r"(?<!\w)\*(?!\s)|(?<!\s)\*(?!\w)", ""))


def label_stem(x: Column) -> Column:
    """What variants of a speaker's printed label share: no marks, parentheticals, or closing dash or colon."""
    bare = F.regexp_replace(clean_markdown(x), r"\s*\([^)]*\)", "")
    return F.lower(collapse(F.regexp_replace(bare, r"[\s:.–—-]+$", "")))


def accent_code(x: Column, codes: dict[str, str]) -> Column:
    """The code of the first of a list separated by |: unknown ones are "other", and none is "any"."""
    first = F.lower(strip(F.split_part(x, F.lit("|"), F.lit(1))))
    known = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return F.when(F.coalesce(first, F.lit("")) == "", "any").otherwise(F.coalesce(F.try_element_at(known, first), F.lit("other")))


def generic_alias(x: Column) -> Column:
    """Whether an alias is a mere descriptor: a name or epithet has an upper-case letter."""
    return ~x.rlike(r"\p{Lu}")


def safe_filename(x: Column) -> Column:
    """A title as a file name: slashes of both kinds become underscores."""
    return F.translate(x, "/\\", "__")


def variant_tag(encoder: Column, cap: Column, decoder: Column, plain: str = "bnb4") -> Column:
    """What of a render's recipe differs from the first one, as a suffix of its key; empty if nothing does."""
    parts = F.concat_ws("+", F.when(encoder != plain, F.concat(F.lit("enc-"), encoder)), F.concat(F.lit("cap"), F.regexp_replace(cap.cast("string"), r"\.0$", "")), F.concat(F.lit("dec-"), F.nullif(decoder, F.lit(""))))
    return F.when(parts == "", "").otherwise(F.concat(F.lit("+"), parts))


# The forms of a prompt that can be tried on a voice.
PROMPT_FORMS = {
    "comma": '{0}, "{1}"', "brackets": '[{0}] "{1}"', "brackets+NL": '[{0}]\n"{1}"', "period": '{0}. "{1}"',
    "colon": '{0}: "{1}"', "dash": '{0} — "{1}"', "line only": '"{1}"',
}


def prompt_forms(descriptor: Column, line: Column) -> Column:
    """An array of (label, prompt): a line in each of the forms."""
    def filled(form: str) -> Column:
        parts = [descriptor if p == "0" else line if p == "1" else F.lit(p) for p in re.split(r"\{([01])\}", form) if p]
        return F.concat(*parts)

    return F.array(*[F.struct(F.lit(label).alias("label"), filled(form).alias("prompt")) for label, form in PROMPT_FORMS.items()])


def speaker_script(prompt: Column) -> Column:
    """(script, speakers) of a prompt: lines without blank ones where any begins with "Speaker N:", and the highest
    number; else all of it as one line of speaker 1."""
    lines = F.filter(F.transform(F.split(prompt, r"\r\n|\r|\n"), lambda x: strip(x)), lambda x: x != "")
    numbers = F.filter(F.transform(lines, lambda x: F.nullif(F.regexp_extract(x, r"(?i)^\s*Speaker\s+(\d+)\s*:", 1), F.lit("")).cast("int")), lambda n: n.isNotNull())
    scripted = F.size(numbers) > 0
    script = F.when(scripted, F.array_join(lines, "\n")).otherwise(F.concat(F.lit("Speaker 1: "), collapse(prompt)))
    return F.struct(script.alias("script"), F.when(scripted, F.array_max(numbers)).otherwise(1).cast("long").alias("speakers"))
