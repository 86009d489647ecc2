"""Readers and writers: text folders, JSON lines, TSV of utterances, EPUB containers, scripts, manifests, sounds."""

from loomline.sources.books import epub_members, epub_pages, epub_table, image_order, narrated, part_groups, prior_volumes
from loomline.sources.files import (
    best_existing, chapter_filter, deleted, folder_chapters, newest_file, read_jsonl, read_manifest, read_scripts, read_utterances,
    sound_durations, stage_artifacts, upserted, write_chapter_texts, write_chapters, write_jsonl, write_whole,
)

__all__ = [
    "best_existing", "chapter_filter", "deleted", "epub_members", "epub_pages", "epub_table", "folder_chapters", "image_order",
    "narrated", "newest_file", "part_groups", "prior_volumes", "read_jsonl", "read_manifest", "read_scripts", "read_utterances",
    "sound_durations", "stage_artifacts", "upserted", "write_chapter_texts", "write_chapters", "write_jsonl", "write_whole",
]
