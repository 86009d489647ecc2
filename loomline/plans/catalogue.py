"""All queries on the engine's own operators, by name, and the DuckDB SQL of each that SQL can express."""

from loomline.plans import alignment_queries, casting_queries, sync_queries, text_queries, timeline_queries  # noqa: F401
from loomline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
