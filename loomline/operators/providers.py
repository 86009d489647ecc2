"""Model providers behind a contract: cached by content, called in batches for what is missing, answers repaired."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.numbers import temperature
from loomline.functions.strings import content_key
from loomline.operators.cut import written

Provider = Callable[[str], str | None]


def extract_json(text: str) -> str:
    """What of an answer is JSON: the inside of a fence, else from the first brace or bracket to the last."""
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL):
        text = m[1]
    if m := re.search(r"[\[{].*[\]}]", text, re.DOTALL):
        return m[0]
    return text.strip()


def salvage(text: str, key: str) -> list[dict]:
    """The complete objects of a list under a key, up to the first that is cut short."""
    m = re.search(rf'"{re.escape(key)}"\s*:\s*\[', text)
    out: list[dict] = []
    if not m:
        return out
    decoder, at = json.JSONDecoder(), m.end()
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except (ValueError, IndexError):
            return out
        if isinstance(value, dict):
            out.append(value)


def as_list(value: object) -> list[str]:
    """A scalar as a list of one, null as none."""
    if value is None or value == "":
        return []
    return [str(v) for v in value] if isinstance(value, list) else [str(value)]


def salvaged(answers: DataFrame, keys: tuple[str, ...] = ("characters", "cast_of_characters", "cast")) -> DataFrame:
    """(answer_id, entry_no, name, aliases) of answers (answer_id, raw): whole JSON, or what can be saved of it."""

    def entries(raw: str) -> Iterable[dict]:
        text = extract_json(raw)
        try:
            whole = json.loads(text)
            found = whole if isinstance(whole, list) else next((whole[k] for k in keys if isinstance(whole, dict) and k in whole), [])
            return [x for x in found if isinstance(x, dict)]
        except ValueError:
            return next((s for k in keys if (s := salvage(raw, k))), [])

    def run(batches):
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column("answer_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                rows += [(i, n, str(x.get("name", "")), as_list(x.get("aliases"))) for n, x in enumerate(entries(raw or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], ["answer_id", "entry_no", "name", "aliases"])

    return answers.select("answer_id", "raw").mapInArrow(run, "answer_id long, entry_no long, name string, aliases array<string>")


ATTEMPTS, FEEDBACK_CHARS, GROWTH = 3, 300, 1.5  # fixed: of one call


def _takes_settings(provider) -> bool:
    """Whether a provider is called with a temperature and a token budget beside the prompt."""
    try:
        return len(inspect.signature(provider).parameters) >= 3
    except (TypeError, ValueError):
        return False


def ask(provider, prompt: str, check=json.loads, salvaged_by=None, attempts: int = ATTEMPTS, budget: int = 8192, most: int = 65536) -> tuple[str | None, str]:
    """(answer, diagnosis) of one call: the JSON text that passes check, or what salvaged_by makes of the last answer, or
    null with what went wrong.

    A provider takes a prompt, or a prompt, a temperature and a token budget, and returns a text, or a text and why it
    ended. An answer that was cut for its length is asked for again as it was, with a budget grown by half, as long as
    that fits; one that fails the check is asked for again with the error told, and a higher temperature."""
    hot, told, raw, why = 0, "", "", ""
    full = _takes_settings(provider)
    for _ in range(attempts):
        asked = f"{prompt}\n\nThe answer before was not valid: {told}\nReturn one complete JSON object." if told else prompt
        got = provider(asked, temperature(hot), budget) if full else provider(asked)
        raw, end = got if isinstance(got, tuple) else (got, "stop")
        raw = raw or ""
        try:
            text = extract_json(raw)
            check(text)
            return text, ""
        except Exception as e:  # noqa: BLE001 - any failure of a check is one more attempt
            why = f"{type(e).__name__}: {e}"[:FEEDBACK_CHARS]
        if end == "length":
            grown, told = min(int(budget * GROWTH), most), ""
            if grown <= budget:
                break
            budget = grown
        else:
            hot, told = hot + 1, why.splitlines()[0]
    if salvaged_by is not None and (found := salvaged_by(raw)) is not None:
        return found, ""
    return None, f"{why} ({len(raw)} characters, budget {budget})"


def called(prompts: DataFrame, provider: Provider, check=json.loads, salvaged_by=None) -> DataFrame:
    """(cache_key, answer) of prompts (cache_key, prompt), each asked for as ask() does; null where nothing could be had."""

    def run(batches):
        for batch in batches:
            found = [ask(provider, p or "", check, salvaged_by)[0] for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cache_key"), pa.array(found, pa.string())], ["cache_key", "answer"])

    return prompts.select("cache_key", "prompt").mapInArrow(run, "cache_key string, answer string")


def answered(rows: DataFrame, prompt: str, schema: str, model: str, provider: Provider, cache: DataFrame | None, check=json.loads, salvaged_by=None) -> tuple[DataFrame, DataFrame]:
    """rows with answer, and the new rows for the cache (cache_key, answer). Keys are of schema, prompt and model; each
    missing one is asked for once, and a cached answer that isn't JSON counts as missing. The new answers are written
    before they are used, so no prompt is sent twice. Without a cache (None) all of them are asked for."""
    keyed = rows.withColumn("cache_key", content_key(F.lit(schema), F.col(prompt), F.lit(model)))
    cache = keyed.sparkSession.createDataFrame([], "cache_key string, answer string") if cache is None else cache
    good = cache.where(F.expr("try_parse_json(answer)").isNotNull()).dropDuplicates(["cache_key"])
    missing = keyed.select("cache_key", F.col(prompt).alias("prompt")).dropDuplicates(["cache_key"]).join(good.select("cache_key"), "cache_key", "left_anti")
    new = written(called(missing, provider, check, salvaged_by), "answers")
    return keyed.join(good.select("cache_key", "answer").unionByName(new), "cache_key", "left"), new


def rule_based_cue(prompt: str) -> str:
    """A deterministic stand-in for a model: an emotion by punctuation."""
    mood = "excited" if "!" in prompt else "curious" if "?" in prompt else "calm"
    return json.dumps({"emotion": mood, "chars": len(prompt)})
