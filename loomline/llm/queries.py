"""The queries of this subpackage: one thin query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm.fingerprints import edited_fingerprints
from loomline.llm.html_main import extracted
from loomline.llm.language import identified
from loomline.llm.licences import licences
from loomline.llm.media import features, stored, with_metadata
from loomline.llm.mixing import domains_of, mixed
from loomline.llm.ngram_join import near_duplicates
from loomline.llm.packing import packed
from loomline.llm.pii import private_values
from loomline.llm.quality import judged
from loomline.llm.shared import table

KEY = b"loomline example key"  # a real deployment brings its own secret
TOKENIZER = "byte_bpe_50k.json"
TARGETS = {"clean": 0.85, "toxic": 0.05, "poor": 0.10}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), TARGETS)


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_values(table(spark, sf_dir, "documents"), KEY)


def op3_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op7_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op9_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = stored(table(spark, sf_dir, "documents"))
    return features(with_metadata(index, folder), folder)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_feistel_pii": op2_feistel_pii,
    "op3_differencing_packing": op3_differencing_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_scaled_fingerprints": op5_scaled_fingerprints,
    "op6_main_text": op6_main_text,
    "op7_line_field_quality": op7_line_field_quality,
    "op8_licence_scan": op8_licence_scan,
    "op9_media_shards": op9_media_shards,
    "op10_language_id": op10_language_id,
}
# Every pair that shares a shingle is compared here, which only small tables allow.
OP4_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0d]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
    u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(sh)"""
ORACLE_SQL: dict[str, str] = {"op4_ngram_join": OP4_SQL}
