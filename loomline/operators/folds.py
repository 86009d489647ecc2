"""Folds whose steps depend on the ones before: fusion of beats, and packing into sessions. A scene's beats go through
them in order in one row, in time and memory that follow their number."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import collapse
from loomline.operators.segments import MAX_CHARS, packed_pieces

SPEAKERS, SESSION_CHARS = 4, 3000  # fixed: what a session holds


def _folded(beats: DataFrame, key: str, order: str, columns: list[str], fold, schema: str) -> DataFrame:
    """The rows that fold makes of each key's beats in order: fold takes a list of dicts and yields tuples."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(c) for c in columns])))
    scenes = beats.groupBy(F.col(key).alias("key")).agg(held.alias("beats"))
    kinds = [(f.split()[0], f.split()[1]) for f in schema.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(fold(batch.column("beats")[i].as_py()))
                own = pa.array([batch.column("key")[i].as_py()] * len(rows), batch.schema.field("key").type)
                yield pa.RecordBatch.from_arrays([own, *(pa.array([r[j] for r in rows], arrow[k]) for j, (_, k) in enumerate(kinds))], ["key", *(n for n, _ in kinds)])

    out = scenes.mapInArrow(run, f"key {scenes.schema['key'].dataType.simpleString()}, {schema}")
    return out.withColumnRenamed("key", key)


def fused(beats: DataFrame, key: str, order: str, most: int = MAX_CHARS) -> DataFrame:
    """(key, fused_no, type, speaker, text, n_beats) of beats (key, order, type, speaker, text): a beat joins the one
    before if the types agree, the joined text is within the limit, and it is narration or has the same known speaker.
    source_span, where beats have it, is joined of the spans that aren't empty. A null text counts as empty."""
    spans = "source_span" in beats.columns

    def fold(rows):
        no, now = 0, None
        for b in rows:
            text, span = b["text"] or "", b["source_span"] or "" if spans else ""
            if now is not None:
                known = b["speaker"] not in (None, "", "Unknown") and b["speaker"] == now[1]
                if b["type"] == now[0] and len(now[2]) + 1 + len(text) <= most and (b["type"] == "narration" or known):
                    now = (*now[:2], f"{now[2]} {text}".strip(), now[3] + 1, [*now[4], span] if span else now[4])
                    continue
                yield (no, *now[:4], *([" ".join(now[4])] if spans else []))
                no += 1
            now = (b["type"], b["speaker"], text, 1, [span] if span else [])
        if now is not None:
            yield (no, *now[:4], *([" ".join(now[4])] if spans else []))

    schema = "fused_no long, type string, speaker string, text string, n_beats long" + (", source_span string" if spans else "")
    return _folded(beats, key, order, ["type", "speaker", "text", *(["source_span"] if spans else [])], fold, schema)


def split_again(beats: DataFrame, key: str, most: int = MAX_CHARS) -> DataFrame:
    """Fused beats over the limit become packed pieces; their source spans, if any, are packed alike and paired by
    position, and a piece without a partner has an empty one."""
    spans = packed_pieces(F.col("source_span"), most) if "source_span" in beats.columns else F.array().cast("array<string>")
    pieces = beats.select("*", F.posexplode(packed_pieces(F.col("text"), most)).alias("piece_no", "piece"), spans.alias("__spans"))
    out = pieces.withColumn("text", F.col("piece")).withColumn("source_span", F.coalesce(F.get("__spans", F.col("piece_no")), F.lit("")))
    return out.drop("piece", "__spans")


def sessions(beats: DataFrame, key: str, order: str, speakers: int = SPEAKERS, most: int = SESSION_CHARS) -> DataFrame:
    """beats (key, order, speaker, text) with session_no from 1: a session closes before a further new speaker once it
    has so many, or before its characters would exceed the limit; a longer beat is a session by itself."""

    def fold(rows):
        no, who, chars = 1, set(), 0
        for b in rows:
            n = len(b["text"] or "")
            if who and (b["speaker"] not in who and len(who) >= speakers or chars + n > most):
                no, who, chars = no + 1, set(), 0
            who.add(b["speaker"])
            chars += n
            yield b["o"], b["speaker"], b["text"], no

    kind = beats.schema[order].dataType.simpleString()
    out = _folded(beats.withColumn("speaker", F.coalesce("speaker", F.lit(""))), key, order, ["speaker", "text"], fold, "o long, speaker string, text string, session_no long")
    return out.withColumn(order, F.col("o").cast(kind)).select(key, order, "speaker", "text", "session_no")


def session_scripts(planned: DataFrame, key: str, order: str) -> DataFrame:
    """(key, session_no, speakers, script): speakers are numbered by their first appearance, lines collapsed."""
    first = planned.withColumn("first", F.min(order).over(Window.partitionBy(key, "session_no", "speaker")))
    numbered = first.withColumn("k", F.dense_rank().over(Window.partitionBy(key, "session_no").orderBy("first")))
    line = F.concat(F.lit("Speaker "), F.col("k").cast("string"), F.lit(": "), collapse(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    who = F.array_sort(F.collect_set(F.struct("k", "speaker")))
    return numbered.groupBy(key, "session_no").agg(F.array_join(F.transform(who, lambda w: w["speaker"]), ",").alias("speakers"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("script"))
