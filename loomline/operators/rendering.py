"""Render plans: unique work by content key, what is pending, splits of over-long prompts, and edges of audio."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import content_key

CAP_SECONDS, TARGET_SECONDS = 22, 18  # fixed: of a rendered chunk
THRESHOLD_DB, PAD_MS, WINDOW_MS, LEAST_MS = -40.0, 100, 10, 50  # fixed: of the edge trim


def unique_renders(beats: DataFrame, order: list[str], *parts: str) -> DataFrame:
    """One row a content key of the parts: the first beat in the given order, and how many beats share it. Aggregated
    with the first beat as a minimum, so that a popular key is combined before the shuffle."""
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("first")
    keyed = beats.groupBy(*parts).agg(first, F.count("*").alias("n_beats"))
    key = content_key(*[F.col(p).cast("string") for p in parts])
    return keyed.select(key.alias("cache_key"), *parts, *[F.col(f"first.{c}").alias(c) for c in order], "n_beats")


def pending(needed: DataFrame, done: DataFrame, key: str = "cache_key") -> DataFrame:
    """What of needed isn't done yet."""
    return needed.join(done.select(key), key, "left_anti")


def first_beats(beats: DataFrame, most: int, *order: str) -> DataFrame:
    """The first beats of a book in playback order, and scenes that are left without any go. A limit over a sort, which
    Spark runs as a top-k in every partition."""
    return beats.orderBy(*order).limit(most)


def split_oversize(prompt: Column, estimate_s: Column, cap: int = CAP_SECONDS, target: int = TARGET_SECONDS) -> Column:
    """An array of prompts: a prompt over the cap is cut by words into max(2, ceil(estimate / target)) parts of equal
    word counts, each with the (direction) header and the quotes of the whole."""
    header = F.regexp_extract(prompt, r'^(\([^)]*\)\s*)?', 1)
    body = F.regexp_replace(prompt, r'^\([^)]*\)\s*', "")
    quoted = body.rlike(r'(?s)^".*"$')
    bare = F.trim(F.when(quoted, F.regexp_replace(body, r'(?s)^"(.*)"$', "$1")).otherwise(body))
    words = F.split(bare, r"\s+")
    parts = F.greatest(F.lit(2), F.ceil(estimate_s / target))
    k = F.greatest(F.lit(1), F.ceil(F.size(words) / parts)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / k).cast("int") - 1), lambda i: F.array_join(F.slice(words, i * k + 1, k), " "))
    mark = F.when(quoted, '"').otherwise("")
    return F.when(estimate_s <= cap, F.array(prompt)).otherwise(F.transform(cut, lambda c: F.concat(header, mark, c, mark)))


def render_plan(beats: DataFrame, voice: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(renders, chunks) of beats (beat_id, pos, prompt, ref, duration_ms): renders by content key, first beat first, and
    their chunks, whose id has the key, the chunk's number and a hash of its text."""
    keyed = beats.withColumn("cache_key", content_key(F.col("prompt"), F.coalesce(F.col(voice), F.lit("")), F.lit(model)))
    renders = keyed.groupBy("cache_key").agg(F.min_by(F.struct("beat_id", "prompt", voice, "duration_ms"), "pos").alias("r"), F.min("pos").alias("pos"), F.count("*").alias("n_beats")).select("cache_key", "pos", "r.*", "n_beats")
    texts = renders.select("cache_key", F.posexplode(split_oversize(F.col("prompt"), F.col("duration_ms") / 1000)).alias("chunk_no", "text"))
    item = F.concat("cache_key", F.lit("_c"), F.lpad(F.col("chunk_no").cast("string"), 2, "0"), F.lit("-"), F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(8)))
    return renders, texts.withColumn("item_id", item)


def attempts(log: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The keys tried most often."""
    return log.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def trim_edges(samples: np.ndarray, rate: int) -> tuple[int, int]:
    """What to keep of (frames, channels) samples in -1 to 1: without quiet edges but for a pad. All of it if everything
    is quiet, or if less than LEAST_MS would go."""
    n, w = len(samples), max(1, rate * WINDOW_MS // 1000)
    if not n:
        return 0, 0
    power = np.square(samples.astype(float)).mean(axis=1)
    total = np.concatenate([[0.0], np.cumsum(power)])
    starts = np.arange(0, n, w)
    ends = np.minimum(starts + w, n)
    loud = np.flatnonzero(np.sqrt((total[ends] - total[starts]) / (ends - starts)) > 10 ** (THRESHOLD_DB / 20))
    if not len(loud):
        return 0, n
    pad = rate * PAD_MS // 1000
    a, b = max(0, int(starts[loud[0]]) - pad), min(n, int(ends[loud[-1]]) + pad)
    return (0, n) if (n - (b - a)) * 1000 < LEAST_MS * rate else (a, b)


def read_wave(data: bytes) -> tuple[np.ndarray, int]:
    """(frames, channels) in -1 to 1 and the rate of 16-bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return raw / 32768.0, w.getframerate()


def wave_ms(data: bytes) -> int:
    """The duration by the header; 0 where there is none."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() * 1000 // w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return 0


def edge_trim(audio: DataFrame) -> DataFrame:
    """(beat_id, frames, first, last) of audio (beat_id, sample_rate, channels, pcm): what trimming keeps of each."""

    def run(batches):
        for batch in batches:
            rows = []
            for rate, channels, pcm in zip(*(batch.column(c).to_pylist() for c in ("sample_rate", "channels", "pcm")), strict=True):
                x = np.frombuffer(pcm or b"", "<i2").reshape(-1, channels or 1) / 32768.0
                rows.append((len(x), *trim_edges(x, rate)))
            yield pa.RecordBatch.from_arrays([batch.column("beat_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], ["beat_id", "frames", "first", "last"])

    return audio.select("beat_id", "sample_rate", "channels", "pcm").mapInArrow(run, "beat_id string, frames long, first long, last long")


def joined(chunks: list[np.ndarray], rate: int, fade_ms: int = 50) -> np.ndarray:
    """Chunks of (frames, channels) in a row with linear crossfades; mono goes to as many channels as the widest has."""
    width = max(c.shape[1] for c in chunks)
    out = np.broadcast_to(chunks[0], (len(chunks[0]), width)) if chunks[0].shape[1] == 1 else chunks[0]
    for c in chunks[1:]:
        c = np.broadcast_to(c, (len(c), width)) if c.shape[1] == 1 else c
        k = min(rate * fade_ms // 1000, len(out), len(c))
        ramp = np.linspace(0.0, 1.0, k)[:, None] if k else np.zeros((0, 1))
        out = np.concatenate([out[: len(out) - k], out[len(out) - k :] * (1 - ramp) + c[:k] * ramp, c[k:]])
    return out


def reference_audio(samples: np.ndarray, rate: int, seconds: float = 10.0, peak: float = 0.95) -> np.ndarray:
    """A reference of that length: tiled or cut, and scaled to the peak."""
    n = int(rate * seconds)
    out = np.tile(samples, (-(-n // max(1, len(samples))), 1))[:n] if len(samples) else np.zeros((n, 1))
    top = np.abs(out).max(initial=0.0)
    return out * (peak / top) if top else out


def sorted_for_shapes(work: DataFrame, frames: str = "n_frames") -> DataFrame:
    """Work by frames, within partitions dealt by range, so that neighbours have equal shapes."""
    return work.repartitionByRange(F.col(frames)).sortWithinPartitions(frames)


def newest(files: DataFrame, key: str) -> DataFrame:
    """The newest path of each key."""
    return files.groupBy(key).agg(F.max_by("path", "modified").alias("path"))


def global_positions(beats: DataFrame, *order: str) -> DataFrame:
    """A book-wide position for beats (chapter_id, ...), in two steps: counts of chapters, then ranks inside each, so no
    window spans a book's beats. A book is a value of book_id; without that column there is one book."""
    keys = ["book_id", "chapter_id"] if "book_id" in beats.columns else ["chapter_id"]
    counts = beats.groupBy(*keys).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*(keys[:-1] or [F.lit(0)])).orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(*keys, "base")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return beats.join(before, keys).withColumn("position", (F.col("base") + rank).cast("long")).drop("base")
