"""Plain files."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.strings import slug
from loomline.operators.rendering import wave_ms
from loomline.operators.segments import chapters_from_texts

UTTERANCES = "client_id string, path string, sentence string, up_votes string, down_votes string, age string, gender string, accents string, variant string"
CLIPS = "id string, source string, clip_path string, duration_seconds double, gender string, age_band string, accent string, sample_sentences array<string>, license string, notes string"
TSV_FILES = ("preferred.tsv", "validated.tsv", "train.tsv", "dev.tsv", "test.tsv")


def folder_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of the *.txt files of a folder: (chapter_id, title, text)."""
    texts = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return chapters_from_texts(texts.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def best_existing(spark: SparkSession, folder: str, names: tuple[str, ...] = TSV_FILES) -> str:
    """The path of the first of names that is in the folder, by Spark's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(conf).exists(path):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"{folder} has none of {', '.join(names)}")


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of utterances, columns by the header's names; quotes are ordinary characters."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    kinds = [c.split()[0] for c in UTTERANCES.split(", ")]
    return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in kinds])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The clips of a voice bank; none where there is no file yet."""
    try:
        return spark.read.schema(CLIPS).json(path)
    except AnalysisException:
        return spark.createDataFrame([], CLIPS)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def chapter_filter(df: DataFrame, wanted: str, column: str = "chapter_id") -> DataFrame:
    """The chapters of a comma-separated list; all of them if it is empty. Reaches the scan as a filter."""
    ids = [x.strip() for x in wanted.split(",") if x.strip()]
    return df.where(F.col(column).isin(ids)) if ids else df


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Chapters as JSON by chapter, under slugs of their titles."""
    named = chapters.withColumn("slug", F.concat(F.col("chapter_id"), F.lit("-"), slug(F.col("title"))))
    named.write.mode("overwrite").partitionBy("chapter_id").json(path)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, line_no, line) of theatre scripts (*.md) under a path: whole files, lines from 0."""
    texts = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return texts.select(stem.alias("scenario_id"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def stage_artifacts(spark: SparkSession, path: str, schema: str, wanted: str = "") -> DataFrame:
    """The rows of a stage's JSON files, one a chapter, of the wanted chapters (a comma-separated list) or all of them."""
    rows = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json")
    return chapter_filter(rows, wanted)


def sound_durations(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, duration_ms) of the WAV files under a path; 0 where a header can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for batch in batches:
            found = pa.array([wave_ms(x or b"") for x in batch.column("content").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("modified"), found], ["path", "modified", "duration_ms"])

    return files.select("path", F.col("modificationTime").alias("modified"), "content").mapInArrow(run, "path string, modified timestamp, duration_ms long")


def newest_file(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The path of the newest file that matches under a path; none if there is none. Reads no contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_whole(path: str, data: bytes) -> None:
    """Writes a small file so that readers see all of it or nothing: beside its place, then moved there."""
    system, at = place(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    beside = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(beside) as f:
        f.write(data)
    system.move(beside, at)


def write_chapter_texts(chapters: DataFrame, folder: str, metadata: dict | None = None) -> int:
    """Writes chapters (chapter_no, title, text) as NN-slug.txt, the title and a blank line before the text, and the
    metadata beside them; returns how many. Each file is written whole by the task that has the row, so a repeated task
    does no harm. The folder has to be one that executors reach."""
    rows = chapters.select(F.concat(F.lpad(F.col("chapter_no").cast("string"), 2, "0"), F.lit("-"), slug(F.col("title")), F.lit(".txt")).alias("name"), F.concat("title", F.lit("\n\n"), "text").alias("content"))

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                write_whole(f"{folder}/{name}", (content or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    n = rows.mapInArrow(run, "name string").count()
    if metadata is not None:
        write_whole(f"{folder}/.meta.json", json.dumps(metadata, ensure_ascii=False, indent=2).encode())
    return n


def deleted(paths: DataFrame, dry_run: bool = True) -> int:
    """How many of the files of paths (path) there are; with dry_run off they are deleted by the tasks that have them."""

    def run(batches):
        for batch in batches:
            there = []
            for path in batch.column("path").to_pylist():
                system, at = place(path)
                if system.get_file_info(at).type == fs.FileType.File:
                    there.append(path)
                    if not dry_run:
                        system.delete_file(at)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], ["path"])

    return paths.select("path").mapInArrow(run, "path string").count()
