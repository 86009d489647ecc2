"""Incremental forms of what runs in batches."""

from loomline.streaming.ingest import chapter_stream, ingest_available

__all__ = ["chapter_stream", "ingest_available"]
