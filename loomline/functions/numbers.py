"""Durations, budgets and times. Times are whole milliseconds, so sums don't depend on their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_SECOND = 12  # fixed: the pace that a text's duration is estimated by


def ms(text: Column) -> Column:
    """The estimated duration of a text."""
    return F.floor(F.length(text).cast("long") * 1000 / CHARS_PER_SECOND).cast("long")


def srt_time(t: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    t = t.cast("long")
    parts = [F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60]
    two = [F.lpad(p.cast("string"), 2, "0") for p in parts]
    return F.concat(two[0], F.lit(":"), two[1], F.lit(":"), two[2], F.lit(","), F.lpad((t % 1000).cast("string"), 3, "0"))


def frames(seconds: Column, fps: int = 25) -> Column:
    """round(seconds * fps) + 1, half to even, then up to the next 8 k + 1."""
    n = F.bround(seconds * fps, 0).cast("long") + 1
    return (F.ceil((n - 1) / 8) * 8 + 1).cast("long")


def token_budget(chars: Column, desired: Column, floor: int = 512, context: int = 65536, reserve: int = 1024) -> Column:
    """Tokens that an answer may take: what is wanted, less what the prompt leaves of the context, but a floor at least."""
    prompt = F.floor(chars.cast("long") * 2 / 7)  # 3.5 characters a token
    return F.greatest(F.lit(floor), F.least(desired.cast("long"), F.lit(context) - prompt - reserve)).cast("long")


def timeout_seconds(tokens: Column, base: int = 60, per_thousand: int = 50) -> Column:
    return (F.lit(base) + F.floor(tokens * per_thousand / 1000)).cast("long")


def retry_budget(tokens: Column, retries: int, most: int = 32768) -> Column:
    """Grown by half for each retry, and clamped."""
    for _ in range(retries):
        tokens = F.least(F.floor(tokens * 3 / 2), F.lit(most)).cast("long")
    return tokens


def temperature(hot_retries: int, base: float = 0.2) -> float:
    """Of a provider's call after so many answers that were no good (answers cut for length don't count)."""
    return min(1.0, base + 0.4 * hot_retries)


def estimated_seconds(seconds: Column, factor: float = 1.0) -> Column:
    """An estimate times a factor, to a tenth of a second, and three seconds at least."""
    return F.greatest(F.lit(3.0), F.bround(seconds * factor, 1))


# How many tokens each kind of call may take: at least, at most (0: no bound), for each unit, and besides.
BUDGETS = {
    "boundaries": (1024, 8192, 80, 512),  # a unit is a paragraph
    "beats": (4096, 32000, 2, 1024),  # a character of the scene
    "profiles": (4096, 0, 400, 1024),  # a character of the cast
    "normalise": (2048, 0, 0.5, 1024),  # a character of the batch
    "structure": (4096, 0, 1.2, 0),  # a character of the chunk
    "roster": (4096, 0, 200, 1024),  # a speaker
}


def stage_budget(kind: str, units: Column) -> Column:
    """Tokens that a call of a kind may take for so many units."""
    least, most, each, besides = BUDGETS[kind]
    wanted = F.greatest(F.lit(least), (F.floor(units * F.lit(float(each))) + besides).cast("long"))
    return (F.least(F.lit(most), wanted) if most else wanted).cast("long")
