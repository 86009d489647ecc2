"""Cutting texts: paragraphs, sentences, packed pieces, previews, scenes, script sections and runs of dialogue."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import clean_markdown, collapse, label_stem, strip

MAX_CHARS = 375  # fixed: what a packed piece or a fused beat may have


def chapters_from_texts(texts: DataFrame) -> DataFrame:
    """chapter_id, title and body of (name, content): the id is the name's stem up to its first hyphen, the first line
    is the title, and texts without any content are left out."""
    tidy = texts.withColumn("content", strip(F.col("content"))).where("content <> ''")
    stem = F.regexp_replace(F.regexp_extract("name", r"([^/]*)$", 1), r"\.[^.]*$", "")
    parts = F.split("content", "\n", 2)
    return tidy.select(F.split_part(stem, F.lit("-"), F.lit(1)).alias("chapter_id"), strip(parts[0]).alias("title"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text"))


def paragraphs(docs: DataFrame, key: str, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(key, paragraph_no, text): pieces between separators that aren't blank, as they are, from 0."""
    pieces = F.filter(F.split(F.col(text), separator), lambda p: strip(p) != "")
    return docs.select(key, F.posexplode(pieces).alias("paragraph_no", "text"))


def sentences_of(text: Column) -> Column:
    """Sentences: cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(sentences_of(strip(F.col(text)))).alias("sentence_no", "text"))


_SENTENCE_END = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
_BLANK_LINES = re.compile(r"\n[ \t\n\x0b\f\r]*\n")
_WHITE = " \t\n\x0b\f\r"


def _grouped(parts: list[str], most: int, counted: int, joint: str) -> list[str]:
    """Parts in a row, joined: a part opens a new group where what the group counts so far and it exceed the limit."""
    out: list[list[str]] = []
    size = 0
    for part in parts:
        if out and size + counted + len(part) <= most:
            out[-1].append(part)
        else:
            out.append([part])
            size = 0
        size += len(part) + len(joint)
    return [joint.join(g) for g in out]


def _each(fold):
    """An expression that applies fold to a string column: an array of strings; null for null."""

    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else fold(t) for t in texts])

    return F.pandas_udf(run, "array<string>")


def packed_pieces(text: Column, most: int = MAX_CHARS) -> Column:
    """An array of pieces of whole sentences: a sentence opens a new piece where the piece so far and it would exceed
    the limit. A text within the limit is one piece, and a longer sentence is one by itself."""

    def fold(t: str) -> list[str]:
        t = t.strip(_WHITE)
        if len(t) <= most:
            return [t] if t else []
        # a piece counts a space after each of its sentences, and one more before the next
        return _grouped([s for s in _SENTENCE_END.split(t) if s], most, 1, " ")

    return _each(fold)(text)


def chapter_pieces(text: Column, separator: str = "\n\n", most: int = MAX_CHARS) -> Column:
    """The packed pieces of all paragraphs of a chapter's text, in order, as one array."""

    def fold(t: str) -> list[str]:
        out: list[str] = []
        for p in t.split(separator):
            p = p.strip(_WHITE)
            if len(p) <= most:
                out += [p] if p else []
            else:
                out += _grouped([s for s in _SENTENCE_END.split(p) if s], most, 1, " ")
        return out

    return _each(fold)(text)


def lecture_beats(docs: DataFrame, key: str, separator: str = "\n\n", most: int = MAX_CHARS) -> DataFrame:
    """Narration beats of every paragraph's packed pieces: beat_no runs through the chapter."""
    found = paragraphs(docs, key, separator=separator)
    found = found.select(key, F.col("paragraph_no").alias("source_paragraph"), F.posexplode(packed_pieces(F.col("text"), most)).alias("piece", "text"))
    order = Window.partitionBy(key).orderBy("source_paragraph", "piece")
    return found.select(key, (F.row_number().over(order) - 1).alias("beat_no"), "source_paragraph", F.lit("narration").alias("type"), "text")


def preview(text: Column, most: int, marker: str = " […] ") -> Column:
    """The first and last half of a long text around a marker."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half))))


def chapter_chunks(parts: DataFrame, key: str, target: int = 30_000, candidates: int = 6) -> DataFrame:
    """(key, chunk_no, base_paragraph, n_paragraphs, chars) from paragraphs (key, paragraph_no, text).

    What is left of up to 1.3 times the target is one chunk. Else the cut goes among the paragraphs around the ideal
    one, by default the middle candidate (a provider may choose another)."""
    sizes = F.array_sort(F.collect_list(F.struct("paragraph_no", F.length("text").alias("n"))))
    held = parts.groupBy(key).agg(F.transform(sizes, lambda p: p["n"].cast("long")).alias("sizes"))
    kind = held.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for name, lengths in zip(batch.column(key).to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                ends = list(itertools.accumulate(n + 2 for n in lengths))
                at = 0
                for no, cut in enumerate(cuts(ends, target, candidates)):
                    rows.append((name, no, at, cut - at, ends[cut - 1] - (ends[at - 1] if at else 0)))
                    at = cut
            columns = [pa.array([r[i] for r in rows], batch.schema.field(key).type if not i else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, [key, "chunk_no", "base_paragraph", "n_paragraphs", "chars"])

    return held.mapInArrow(run, f"{key} {kind}, chunk_no long, base_paragraph long, n_paragraphs long, chars long")


def cuts(ends: list[int], target: int, candidates: int = 6):
    """The paragraphs before which chunks end, from the ends of paragraphs in characters."""
    n, at, half = len(ends), 0, candidates // 2
    while at < n:
        begin = ends[at - 1] if at else 0
        if n == 1 or ends[-1] - begin <= int(1.3 * target):
            yield n
            return
        ideal = next((i for i in range(at, n) if ends[i] >= begin + target), n - 1)
        low = max(at + 1, ideal - half)
        high = min(n, low + candidates)
        low = max(at + 1, high - candidates)
        at = min(n, low + (high - low) // 2 if high > low else max(ideal, at + 1))
        yield at


def scenes(parts: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """(key, scene_no, text) of paragraphs (key, paragraph_no, text) in boundaries (key, bound_no, first, last).

    Boundaries count from 1, include both ends and are clamped to what there is; gaps and overlaps stay. Scenes without
    text are dropped, and those kept are numbered from 1. A chapter without boundaries is one scene."""
    counts = parts.groupBy(key).agg((F.max("paragraph_no") + 1).alias("n"))
    clamped = counts.join(bounds, key, "left").select(key, F.coalesce("bound_no", F.lit(0)).alias("bound_no"), F.greatest(F.lit(1), F.least("n", F.coalesce("first", F.lit(1)))).alias("first"), F.greatest(F.lit(1), F.least("n", F.coalesce("last", "n"))).alias("last"))
    inside = clamped.join(parts, key).where((F.col("paragraph_no") + 1).between(F.col("first"), F.col("last")))
    texts = inside.groupBy(key, "bound_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    return texts.where(strip(F.col("text")) != "").select(key, F.row_number().over(Window.partitionBy(key).orderBy("bound_no")).alias("scene_no"), "text")


# Shapes of scene headers, the words that a cast's heading begins with, and labels of groups.
SCENE_HEADERS = (
    r"^#{1,6}\s*\d+\s*[.\\)]?\s*\S",
    r"(?i)^\s*\**\s*(?:s[ée]quence|sc[èe]ne|acte?|p[ée]riode|tableau|partie)\s+[\divxlc]+",
    r"^\*\*\s*\d+\s*\\?\.?\s*\*\*\s*$",
    r"^\*{0,2}\s*\d+\s*[–—-]\s+\S",
)
ROSTER_HEADER = r"(?i)^\s*(?:les\s+)?(?:personnages?|characters?|cast|distribution|dramatis\s+person(?:ae|æ))\b.{0,40}$"
GROUP_LABELS = ["tous", "toutes", "tous ensemble", "ensemble", "all", "choeur"]


def is_scene_header(line: Column) -> Column:
    """A heading that begins with a number, a structural word with a numeral, a bold number, or "3 – Title"."""
    line, found = strip(line), F.lit(False)
    for shape in SCENE_HEADERS:
        found = found | line.rlike(shape)
    return found


def is_roster_header(line: Column) -> Column:
    """A line that begins with a word for the cast and is shaped like a heading: marked as one, bold, in capitals, or of
    one or two words."""
    raw, bare = strip(line), F.regexp_replace(clean_markdown(line), r"^#+\s*", "")
    shaped = raw.startswith("#") | (raw.startswith("**") & raw.endswith("**")) | (F.upper(bare) == bare) | (F.size(F.split(collapse(bare), " ")) <= 2)
    return bare.rlike(ROSTER_HEADER) & shaped


def is_group_label(label: Column) -> Column:
    """Whether a speaker's label stands for several at once."""
    return label_stem(label).isin(*GROUP_LABELS)


def split_script(text: Column, most: int = 7000) -> Column:
    """Parts of a script's text of at most so many characters, cut at blank lines; a longer block is a part by itself,
    and a text within the limit is left as it is."""
    return _each(lambda t: [t] if len(t) <= most else _grouped(_BLANK_LINES.split(t), most, 0, "\n\n"))(text)


def script_sections(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line, section_no, kind, title) of (key, line_no, line): the section that every line belongs to.

    Section 0 is what stands before any header. Header lines open a section and aren't kept in it."""
    order = Window.partitionBy(key).orderBy("line_no")
    kind = F.when(is_roster_header(F.col("line")), "roster").when(is_scene_header(F.col("line")), "scene")
    marked = lines.withColumn("opens", kind)
    marked = marked.withColumn("section_no", F.sum(F.when(F.col("opens").isNotNull(), 1).otherwise(0)).over(order))
    tidy = collapse(F.regexp_replace(F.col("line"), r"[#*]", " "))
    marked = marked.withColumn("kind", F.coalesce(F.last("opens", True).over(order), F.lit("preamble"))).withColumn("title", F.coalesce(F.last(F.when(F.col("opens").isNotNull(), tidy), True).over(order), F.lit("")))
    return marked.where("opens is null").select(key, "line_no", "line", "section_no", "kind", "title")


def dialogue_runs(items: DataFrame, key: str, order: str, kind: str = "type") -> DataFrame:
    """The dialogue rows of items with run_no: staging closes a run, cues don't; runs are numbered from 1."""
    w = Window.partitionBy(key).orderBy(order)
    island = items.withColumn("__island", F.sum(F.when(F.col(kind) == "staging", 1).otherwise(0)).over(w)).where(F.col(kind) == "dialogue")
    return island.withColumn("run_no", F.dense_rank().over(Window.partitionBy(key).orderBy("__island"))).drop("__island")
