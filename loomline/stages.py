"""Whole stages, composed of the operators: from texts, EPUBs and scripts to characters, scenes, directed beats, render
plans, timelines and sync manifests. Tables go in and out; model calls go through providers, cached by content.

A provider is a function from a prompt to an answer; providers maps the names of contracts.CONTRACTS to providers, and a
stage whose provider is missing takes the contract's deterministic way: one scene a chapter, no cues, texts word for word.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import ms
from loomline.functions.voices import AGE_BANDS, GENDERS, NARRATOR, accents, age_band, gender_of
from loomline.operators import alignment, castbook, casting, characters, contracts, direction, finishing, folds, guards, pages, rendering, scripts, segments, sync, timeline
from loomline.operators.contracts import CONTRACTS, asked
from loomline.operators.cut import written
from loomline.sources import epub_pages, folder_chapters, narrated, part_groups, read_scripts


@dataclass(frozen=True)
class Settings:
    """What a run can be told. from_env reads LOOMLINE_<NAME> (also LOOMLINE_<GROUP>__<NAME>); short names of a few values
    count only where the long one is not set."""

    model: str = "rules"
    llm_max_tokens: int = 8192
    llm_context: int = 65536
    separator: str = "\n\n"
    intra_ms: int = timeline.INTRA
    inter_scene_ms: int = timeline.INTER_SCENE
    inter_chapter_ms: int = timeline.INTER_CHAPTER
    lead_in_ms: int = timeline.LEAD_IN
    session_chars: int = folds.SESSION_CHARS

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "LOOMLINE_") -> Settings:
        short = {"MODEL_NAME": "model", "MAX_TOKENS": "llm_max_tokens", "CONTEXT": "llm_context"}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        given = {k.removeprefix(prefix).lower().replace("__", "_"): v for k, v in env.items() if k.startswith(prefix)}
        for alias, name in short.items():
            if alias in env:
                given.setdefault(name, env[alias])
        return replace(cls(), **{k: kinds[k](v) for k, v in given.items() if k in kinds})


Providers = Mapping[str, object]


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """chapters (chapter_id, title, text) of a folder of texts."""
    return folder_chapters(spark, folder)


def ingest_epub(spark: SparkSession, path: str) -> DataFrame:
    """chapters (path, chapter_id, title, parts, text) of EPUBs for narration: a paragraph for each p of their text pages."""
    rows = narrated(epub_pages(spark, path)).withColumn("page_id", F.xxhash64("path", "href"))
    texts = pages.page_text(rows)
    both = rows.select("page_id", "path", "spine_idx", "stem").join(texts, "page_id")
    out = part_groups(both, "path")
    return out.where("text <> ''").withColumn("chapter_id", F.lpad(F.col("chapter_no").cast("string"), 2, "0"))


def ingest_lecture_epub(spark: SparkSession, path: str, providers: Providers | None = None, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(chapters, visual elements) of EPUBs for lectures: pages are chapters, prose blocks their paragraphs; all other blocks
    stand between these. Ambiguous blocks go to the provider "block", else are prose."""
    settings, providers = settings or Settings(), providers or {}
    rows = epub_pages(spark, path).withColumn("page_id", F.xxhash64("path", "href"))
    # the rule of stems is asked of a page's title, as files are named at will
    titles = written(pages.page_titles(rows), "titles")
    drops = pages.page_drops(rows.join(titles, "page_id").select("page_id", F.left("title", F.lit(40)).alias("stem"), "html"))
    kept = rows.join(drops.where("reason is null").select("page_id"), "page_id", "left_semi")
    blocks = written(pages.page_blocks(kept), "blocks")
    answers = None
    if "block" in providers:
        unclear = blocks.where("kind = 'ambiguous'").select("page_id", "block_no", "text")
        found, _ = asked(unclear, CONTRACTS["block"], {"html": F.left("text", F.lit(2000))}, providers["block"], settings.model)
        answers = found.select("page_id", "block_no", F.col("kind").alias("answer"))
    blocks = pages.resolved(blocks, answers)
    prose = blocks.where("kind = 'prose'").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), settings.separator).alias("text"))
    chapters = kept.select("path", "page_id", "spine_idx").join(titles, "page_id").join(prose, "page_id")
    chapters = chapters.withColumn("chapter_id", F.lpad(F.row_number().over(Window.partitionBy("path").orderBy("spine_idx")).cast("string"), 2, "0"))
    elements = pages.chapter_positions(blocks.join(chapters.select("path", "page_id", "chapter_id", "spine_idx"), "page_id"))
    return chapters.select("path", "chapter_id", "title", "text"), elements.select("path", "chapter_id", "kind", "language", "after_paragraph")


def extract_characters(chapters: DataFrame, providers: Providers, settings: Settings | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Characters of a book's chapters (chapter_id, text), by the providers "mentions" and, if there, "merges": mentions of
    every chapter are clustered by names, and the provider may propose which clusters are one person."""
    settings = settings or Settings()
    found, _ = asked(chapters.select("chapter_id", "text"), CONTRACTS["mentions"], {"text": F.col("text")}, providers["mentions"], settings.model, cache)
    order = Window.orderBy("chapter_id", "item_no")  # mentions are few: some tens a chapter
    mentions = written(found.withColumn("entry_id", F.row_number().over(order).cast("long")).drop("item_no", "text"), "mentions")
    cast = written(characters.clusters(mentions), "clusters")
    return characters.merged_by_provider(cast, providers["merges"]) if "merges" in providers else cast


def segment_scenes(chapters: DataFrame, cast: DataFrame, providers: Providers, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(scenes, beats) of chapters (chapter_id, text): boundaries by the provider "boundaries", else one scene a chapter;
    beats by "beats", whose speakers are rewritten to the cast's names (name, aliases). A scene without beats is an error."""
    settings = settings or Settings()
    parts = written(segments.paragraphs(chapters, "chapter_id", separator=settings.separator), "paragraphs")
    bounds = chapters.sparkSession.createDataFrame([], f"chapter_id {parts.schema['chapter_id'].dataType.simpleString()}, bound_no long, first long, last long")
    if "boundaries" in providers:
        chunks = segments.chapter_chunks(parts, "chapter_id")
        inside = chunks.join(parts, "chapter_id").where("paragraph_no >= base_paragraph and paragraph_no < base_paragraph + n_paragraphs")
        line = F.concat(F.lit("["), (F.col("paragraph_no") + 1).cast("string"), F.lit("] "), F.col("text"))
        numbered = inside.groupBy("chapter_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("paragraphs"))
        found, _ = asked(numbered, CONTRACTS["boundaries"], {"paragraphs": F.col("paragraphs")}, providers["boundaries"], settings.model)
        number = F.row_number().over(Window.partitionBy("chapter_id").orderBy("chunk_no", "item_no")).cast("long")
        bounds = found.select("chapter_id", number.alias("bound_no"), F.col("start_paragraph").alias("first"), F.col("end_paragraph").alias("last"))
    scenes = segments.scenes(parts, bounds, "chapter_id").withColumn("scene_id", F.concat_ws("_s", "chapter_id", F.lpad(F.col("scene_no").cast("string"), 2, "0")))
    scenes = written(scenes, "scenes")
    known = F.lit(", ".join(r.name for r in characters.ranked(cast).collect())) if cast is not None else F.lit("")
    # the scene's text gives way to the beat's
    rows = scenes.select("chapter_id", "scene_id", "scene_no", F.col("text").alias("scene_text"))
    found, _ = asked(rows, CONTRACTS["beats"], {"speakers": known, "text": F.col("scene_text")}, providers["beats"], settings.model)
    found = written(found.drop("scene_text"), "beats")
    held = found.groupBy("scene_id").agg(F.count("*").alias("n_beats"))
    checked = guards.with_beats(scenes.select("scene_id").join(held, "scene_id", "left").withColumn("n_beats", F.coalesce("n_beats", F.lit(0))))
    beats = found.join(checked, "scene_id").select("chapter_id", "scene_id", "scene_no", F.col("item_no").alias("pos"), "type", "text", "speaker", "source_span")
    if cast is not None:
        aliases = cast.select(F.col("name"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("ordinal", "alias"))
        beats = casting.rewritten_speakers(beats, aliases).drop("rewritten")
    return scenes, beats


def direct(beats: DataFrame, cast: DataFrame, clips: DataFrame, castings: DataFrame, providers: Providers, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(directed beats, profiles) of beats (chapter_id, scene_id, pos, type, speaker, text, source_span): profiles by the
    provider "profiles", snapped to the assigned clips (castings: name, clip_id); neighbouring beats of a speaker fused and
    cut again; cues by "cues"."""
    settings = settings or Settings()
    spark = beats.sparkSession
    told = spark.createDataFrame([], CONTRACTS["profiles"].fields)
    if "profiles" in providers:
        held = "; ".join(f"{r.name}: {r.description}" for r in characters.ranked(cast).collect())
        told, _ = asked(spark.range(1).select(F.lit(held).alias("cast")), CONTRACTS["profiles"], {"cast": F.col("cast")}, providers["profiles"], settings.model)
        told = told.select(*CONTRACTS["profiles"].kinds())
    ranked = cast.select("name", F.row_number().over(Window.orderBy(F.desc("occurrences"), F.lower("name"))).alias("cast_no"))
    profiles = direction.snapped_profiles(told.join(castings.select("name", "clip_id"), "name", "left"), clips)
    profiles = written(direction.ordered_profiles(profiles, ranked), "profiles")
    fused = folds.fused(beats, "scene_id", "pos").withColumnRenamed("fused_no", "pos")
    cut = folds.split_again(fused, "scene_id").withColumn("pos", F.row_number().over(Window.partitionBy("scene_id").orderBy("pos", "piece_no")).cast("long")).drop("piece_no")
    cut = written(cut.join(beats.select("scene_id", "chapter_id").distinct(), "scene_id"), "cut")
    cues = spark.createDataFrame([], "scene_id string, line_no long, cue string")
    if "cues" in providers:
        talk = cut.where("type = 'dialogue'").withColumn("line_no", F.row_number().over(Window.partitionBy("scene_id").orderBy("pos")))
        line = F.concat(F.col("line_no").cast("string"), F.lit(". "), F.coalesce("speaker", F.lit("")), F.lit(": "), "text")
        lines = talk.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
        cues, _ = asked(lines, CONTRACTS["cues"], {"lines": F.col("lines")}, providers["cues"], settings.model)
        cues = cues.select("scene_id", F.col("line").alias("line_no"), "cue")
    return direction.directed(cut, profiles, cues), profiles


def lecture(chapters: DataFrame, providers: Providers | None = None, settings: Settings | None = None) -> DataFrame:
    """Narration beats (chapter_id, pos, source_paragraph, text, source_span) of chapters: packed pieces of paragraphs, whose
    text the provider "normalise" writes as it is spoken; batches that fail stay word for word."""
    settings, providers = settings or Settings(), providers or {}
    beats = segments.lecture_beats(chapters, "chapter_id", settings.separator).withColumnRenamed("beat_no", "pos").withColumn("source_span", F.col("text"))
    if "normalise" not in providers:
        return beats
    beats = written(beats, "beats")
    calls = direction.batches(beats, "chapter_id", "pos")
    found, _ = asked(calls, CONTRACTS["normalise"], {"passages": F.col("passages")}, providers["normalise"], settings.model)
    return direction.normalised(beats, found.select("chapter_id", "batch_no", F.col("index").alias("i"), "text"), "chapter_id", "pos")


def ingest_scenario(spark: SparkSession, path: str, providers: Providers, settings: Settings | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, speakers) of theatre scripts: sections by their headers, long ones cut at blank lines, items by the provider
    "structure", dialogue that isn't in the script word for word made staging, labels made one for each speaker; speakers
    with sample lines, and what the cast list (provider "roster") says of them."""
    settings = settings or Settings()
    lines = segments.script_sections(read_scripts(spark, path), "scenario_id")
    body = lines.groupBy("scenario_id", "section_no", "kind", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    has_scene = F.max((F.col("kind") == "scene").cast("int")).over(Window.partitionBy("scenario_id"))
    body = written(body.withColumn("has_scene", has_scene).where("trim(body) <> ''"), "sections")
    parts = body.where("kind = 'scene' or kind = 'preamble' and has_scene = 0")
    parts = parts.select("scenario_id", "section_no", F.when(F.col("kind") == "scene", F.col("title")).otherwise("").alias("title"), F.posexplode(segments.split_script(F.col("body"))).alias("part_no", "chunk"))
    found, _ = asked(parts, CONTRACTS["structure"], {"text": F.col("chunk")}, providers["structure"], settings.model, cache)
    found = written(alignment.verbatim_items(found), "items")
    labels = scripts.canonical_labels(found)
    named = found.join(labels.withColumnRenamed("label", "speaker"), "speaker", "left").withColumn("speaker", F.coalesce("canonical", F.col("speaker"))).drop("canonical")
    number = F.row_number().over(Window.partitionBy("scenario_id", "section_no").orderBy("part_no", "item_no")).cast("long")
    items = named.withColumn("item_no", number).select("scenario_id", "section_no", "title", "item_no", "type", "speaker", "text")
    order = F.struct("scenario_id", "section_no", "item_no")
    speakers = scripts.sample_lines(items.withColumn("item_no", order))
    roster = spark.createDataFrame([], CONTRACTS["roster"].fields)
    if "roster" in providers:
        roster, _ = asked(body.where("kind = 'roster'").select("body"), CONTRACTS["roster"], {"text": F.col("body")}, providers["roster"], settings.model, cache)
    return items, scripts.rostered(speakers, roster.select("name", "description"))


def sync_scenario(items: DataFrame, rendered: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, srt) of items (scene_id, item_no, type, text) and their rendered chunks (scene_id, pos, group_id, line_no,
    duration_ms)."""
    settings = settings or Settings()
    entries = timeline.sync_entries(items, timeline.line_times(rendered, settings.intra_ms, timeline.SCENARIO_INTER_SCENE, settings.lead_in_ms))
    return entries, timeline.srt_blocks(entries)


def plan_renders(directed: DataFrame, castings: DataFrame, clips: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(renders, chunks) for directed beats (chapter_id, scene_id, pos, speaker, text, prompt): the clip of each speaker, the
    narrator's where there is none."""
    settings = settings or Settings()
    refs = casting.clip_paths(castings.select(F.col("name").alias("speaker"), "clip_id"), clips.select("clip_id", F.col("clip_path")))
    narrator = refs.where(F.col("speaker") == NARRATOR).select(F.col("clip_path").alias("__own")).limit(1)
    rows = directed.join(refs.select("speaker", "clip_path"), "speaker", "left").join(F.broadcast(narrator), F.lit(True), "left")
    beat_id = F.concat_ws("_b", F.col("scene_id").cast("string"), F.lpad(F.col("pos").cast("string"), 4, "0"))
    rows = rows.select(beat_id.alias("beat_id"), F.struct("chapter_id", "scene_id", "pos").alias("pos"), "prompt", F.coalesce("clip_path", "__own").alias("ref"), ms(F.col("text")).alias("duration_ms"))
    return rendering.render_plan(rows, "ref", settings.model)


def mix(beats: DataFrame, titles: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, timings) of rendered beats (book_id, chapter_id, scene_id, pos, duration_ms): what a chapter's mix consists
    of, and where its titled chapters begin and end in the book."""
    settings = settings or Settings()
    items = timeline.mix_plan(beats, settings.intra_ms, settings.inter_scene_ms, settings.lead_in_ms)
    totals = items.groupBy("chapter_id").agg(F.sum("length_ms").alias("total_ms")).join(beats.select("book_id", "chapter_id").distinct(), "chapter_id")
    return items, finishing.titled(finishing.chapter_timings(totals, settings.inter_chapter_ms), titles)


def sync_text(beats: DataFrame, texts: DataFrame, images: DataFrame, elements: DataFrame, book_id: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, manifest, unmatched) for beats (chapter_id, scene_id, pos, beat_id, type, speaker, text, source_span,
    duration_ms) in the text nodes of their chapters (texts: chapter_id, part_no, node_no, xhtml, s, e, raw)."""
    settings = settings or Settings()
    nodes = written(sync.master_shadow(texts), "nodes")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "node_no", "raw"))), lambda n: n["raw"]), " ")
    held = F.array_sort(F.collect_list(F.struct(F.col("pos"), "text", "source_span")))
    rows = beats.groupBy("chapter_id").agg(held.alias("beats")).join(nodes.groupBy("chapter_id").agg(words.alias("text")), "chapter_id", "left")
    found = written(alignment.aligned(rows, "chapter_id"), "matches")
    timed = timeline.beat_timeline(beats, settings.intra_ms, settings.inter_scene_ms, settings.inter_chapter_ms)
    both = timed.join(found, ["chapter_id", "pos"])
    files = sync.containing(both.where("s is not null").select("chapter_id", "beat_id", "s"), nodes, "chapter_id")
    both = both.join(files, ["chapter_id", "beat_id"], "left")
    out = both.select("chapter_id", "pos", "beat_id", F.coalesce("xhtml", F.lit("")).alias("xhtml"), "type", "speaker", "start_ms", "end_ms", "confidence")
    return both, sync.manifest(book_id, out, images, elements), sync.unmatched(both)


def seed_voices(utterances: DataFrame, most: int = 400) -> DataFrame:
    """Clips (client_id, gender, age_band, accent, clip_ms, sentences) of a corpus of utterances (client_id, row_no, path,
    sentence, up_votes, down_votes, age, gender, accents, length_ms): eligible ones, the best of each speaker until the
    target, and the first so many speakers that reach the least length."""
    good = casting.eligible(utterances, list(GENDERS), list(AGE_BANDS))
    score = F.col("up_votes").cast("long") - F.col("down_votes").cast("long")
    parts = casting.assembled_clips(good.select("client_id", F.col("row_no").alias("seg_no"), score.alias("score"), "length_ms"))
    told = castbook.demographics(good)
    out = parts.join(told, "client_id").select("client_id", gender_of(F.col("gender")).alias("gender"), age_band(F.col("age")).alias("age_band"), accents(F.col("accents")).alias("accent"), "clip_ms", "sentences")
    return castbook.first_successes(out.withColumn("ok", F.lit(True)), most).drop("ok")


def cast_voices(cast: DataFrame, clips: DataFrame, prior: DataFrame, targets: DataFrame, profiles: DataFrame, narrator_clip=None) -> DataFrame:
    """The cast book of a cast (name, aliases, gender, approx_age, description), the narrator added: see castbook."""
    chosen = clips.where(F.col("clip_id") == narrator_clip) if narrator_clip is not None else clips.where("false")
    earlier = prior.where((F.col("name") == NARRATOR) & F.col("clip_id").isNotNull()).orderBy(F.desc("volume")).select("gender", F.lit(None).cast("string").alias("age_band")).limit(1)
    people = castbook.with_narrator(cast, chosen.select("gender", "age_band"), earlier, profiles)
    return castbook.cast_book(people, clips, prior, targets, narrator_clip)


def purge(beats: DataFrame, speaker: str, sounds: DataFrame, cached: DataFrame) -> DataFrame:
    """What a purge of a speaker's sounds would delete; sources.deleted does it."""
    return finishing.purge_plan(beats, speaker, sounds, cached)


__all__ = [
    "Settings", "cast_voices", "contracts", "direct", "extract_characters", "ingest", "ingest_epub", "ingest_lecture_epub", "ingest_scenario",
    "lecture", "mix", "plan_renders", "purge", "seed_voices", "segment_scenes", "sync_scenario", "sync_text",
]
