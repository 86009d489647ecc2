"""After rendering: what is still to do, where files go, a book's chapter marks and timings, and what a purge takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.rendering import pending
from loomline.operators.timeline import INTER_CHAPTER

STALL_LIMIT = 10  # fixed: restarts in a row without progress


def titled(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """chapters (chapter_id, ...) with their title (titles: chapter_id, title), else their id."""
    return chapters.join(titles.select("chapter_id", "title"), "chapter_id", "left").withColumn("title", F.coalesce("title", F.col("chapter_id").cast("string")))


def chapter_timings(totals: DataFrame, inter_chapter: int = INTER_CHAPTER, book: str = "book_id") -> DataFrame:
    """totals (book, chapter_id, total_ms, ...) with start_ms and end_ms in the book: a pause after each chapter but the
    last. Books are dealt apart."""
    before = Window.partitionBy(book).orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("total_ms") + inter_chapter).over(before), F.lit(0)).cast("long")
    return totals.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("total_ms"))


def ffmetadata(timings: DataFrame, books: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, text): the chapter marks of each book in the format of ffmetadata, from timings (book, chapter_id, title,
    start_ms, end_ms) and books (book, title)."""
    parts = [F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), F.col("title")]
    marks = timings.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", F.concat(*parts).alias("mark")))), lambda x: x["mark"]), "\n").alias("marks"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), F.col("title"), F.lit("\n"))
    return books.select(book, head.alias("head")).join(marks, book).select(book, F.concat("head", "marks", F.lit("\n")).alias("text"))


def timings_sidecar(timings: DataFrame, settings: dict, book: str = "book_id") -> DataFrame:
    """(book, total_ms, settings, chapters): a row of timings a book, to be written as JSON."""
    item = F.struct("start_ms", "chapter_id", "title", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    held = F.create_map(*[F.lit(str(x)) for pair in sorted(settings.items()) for x in pair]) if settings else F.create_map().cast("map<string,string>")
    return timings.groupBy(book).agg(F.max("end_ms").alias("total_ms"), F.array_sort(F.collect_list(item)).alias("chapters")).withColumn("settings", held)


def pending_by_phase(plan: DataFrame, chunks: DataFrame, done: dict[str, DataFrame], scale: float = 1.0) -> DataFrame:
    """(phase, n): what each phase has still to do for a plan's renders (cache_key, ref_hash) and chunks (cache_key,
    item_id). Only renders without a finished sound count. done: tables of keys under "renders" (cache_key), "refs"
    (ref_hash), "contexts" and "latents" (item_id), and "negative" (any row: the negative prompt is there).

    With a guidance scale over 1 the contexts include the negative prompt, if anything is to be rendered at all."""
    live = pending(plan.select("cache_key", "ref_hash"), done["renders"], "cache_key")
    refs = pending(live.where("ref_hash is not null and ref_hash <> ''").select("ref_hash").distinct(), done["refs"], "ref_hash")
    parts = chunks.select("cache_key", "item_id").join(live.select("cache_key").distinct(), "cache_key", "left_semi")
    contexts, latents = (pending(parts, done[name], "item_id") for name in ("contexts", "latents"))

    def count(df: DataFrame, phase: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).withColumn("phase", F.lit(phase))

    negative = live.limit(1).select(F.lit(1).alias("k")).join(done["negative"].limit(1).select(F.lit(1).alias("k")), "k", "left_anti") if scale > 1 else live.where("false")
    out = count(refs, "refs").unionByName(count(contexts, "ctx")).unionByName(count(negative, "ctx")).unionByName(count(latents, "denoise")).unionByName(count(live, "decode"))
    return out.groupBy("phase").agg(F.sum("n").alias("n"))


def driven(phases: list[str], left: Callable[[str], int], run: Callable[[str], bool], stall_limit: int = STALL_LIMIT) -> dict[str, int]:
    """Runs each phase until nothing is left of it, and returns how often each ran. left counts what a phase has to do,
    run does some of it and says whether it ended well. The last phase runs once at least, as it also places what is
    there. A phase that makes no progress so many times in a row is an error; no item is ever skipped."""
    runs: dict[str, int] = {}
    for phase in phases:
        runs[phase] = stalled = 0
        while (before := left(phase)) or phase == phases[-1] and not runs[phase]:
            runs[phase] += 1
            well = run(phase)
            after = left(phase)
            if well and not after:
                break
            stalled = 0 if after < before else stalled + 1
            if stalled >= stall_limit:
                raise RuntimeError(f"{phase} made no progress in {stall_limit} runs, with {after} left")
    return runs


def placements(beats: DataFrame, cache: DataFrame, placed: DataFrame) -> DataFrame:
    """(chapter_id, beat_id, cache_key, action, duration_ms) for beats (chapter_id, pos, beat_id, cache_key): copy where a
    beat's file isn't placed yet or is older than the sound in the cache, else keep. cache: (cache_key, modified,
    duration_ms), placed: (beat_id, modified). A beat without a placed file or a cached sound is an error."""
    rows = beats.join(cache.select("cache_key", F.col("modified").alias("__made"), "duration_ms"), "cache_key", "left")
    rows = rows.join(placed.select("beat_id", F.col("modified").alias("__placed")), "beat_id", "left")
    missing = F.raise_error(F.concat(F.lit("no sound in the cache for beat "), F.col("beat_id").cast("string"))).cast("string")
    action = F.when(F.col("__placed").isNull() & F.col("__made").isNull(), missing).when(F.col("__placed").isNull() | (F.col("__made") > F.col("__placed")), "copy").otherwise("keep")
    return rows.select("chapter_id", "beat_id", "cache_key", action.alias("action"), "duration_ms")


def chapter_manifests(rendered: DataFrame) -> DataFrame:
    """(chapter_id, n_beats, total_ms, cached) of rendered beats (chapter_id, beat_id, duration_ms, cached)."""
    return rendered.groupBy("chapter_id").agg(F.count("*").alias("n_beats"), F.sum("duration_ms").alias("total_ms"), F.count_if("cached").alias("cached"))


def purge_plan(beats: DataFrame, speaker: str, sounds: DataFrame, cached: DataFrame) -> DataFrame:
    """(chapter_id, beat_id, cache_key, has_sound, has_cached) of a speaker's beats (chapter_id, beat_id, speaker,
    cache_key): which of their files (sounds: beat_id, cached: cache_key) a purge would delete. Nothing is deleted here."""
    own = beats.where(F.lower(F.trim("speaker")) == speaker.strip().lower())
    own = own.join(sounds.select("beat_id", F.lit(True).alias("has_sound")).distinct(), "beat_id", "left")
    own = own.join(cached.select("cache_key", F.lit(True).alias("has_cached")).distinct(), "cache_key", "left")
    return own.select("chapter_id", "beat_id", "cache_key", F.coalesce("has_sound", F.lit(False)).alias("has_sound"), F.coalesce("has_cached", F.lit(False)).alias("has_cached"))


def ordered_images(images: DataFrame) -> DataFrame:
    """images (path) with place: covers and fronts first, the rest by name."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    front = F.when(name.rlike(r"^(?:cover|front)"), 0).otherwise(1)
    return images.withColumn("place", F.row_number().over(Window.orderBy(front, name, "path")))
