"""Scalar expressions: names, labels, prompts, slugs, times and keys. All of them stay inside the JVM."""

from loomline.functions.numbers import frames, ms, retry_budget, srt_time, timeout_seconds, token_budget
from loomline.functions.strings import (
    accent_code,
    clean_markdown,
    collapse,
    content_key,
    digit_runs,
    label_stem,
    normal_name,
    prompt,
    slug,
    spoken_text,
    strip,
    token_sorted,
)

__all__ = [
    "accent_code", "clean_markdown", "collapse", "content_key", "digit_runs", "frames", "label_stem", "ms", "normal_name",
    "prompt", "retry_budget", "slug", "spoken_text", "srt_time", "strip", "timeout_seconds", "token_budget", "token_sorted",
]
