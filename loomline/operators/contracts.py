"""What each kind of model call is asked, what it has to return, and what stands in for it when it fails.

A contract is a prompt with named fields, the top-level key of the answer's list (and other names that models give it), the
fields of an item, and a fallback. Prompts are columns built from rows; answers are checked, cached by content, and come
back as rows of items. Rows whose call fails get the fallback: an error, nothing, or a fixed answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import providers

GENDERS = "male, female, nonbinary, unknown"
AGE_BANDS = "child, teen, young_adult, adult, elder, unknown"


@dataclass(frozen=True)
class Contract:
    """fields: of an item, in DDL of string, array<string>, long and double. keys: names of the list, the first one is
    asked for; none where the answer is one object. fallback: "error", "empty", or the JSON of an answer."""

    name: str
    prompt: str
    fields: str
    keys: tuple[str, ...] = ()
    fallback: str = "error"
    salvage: bool = False
    required: tuple[str, ...] = field(default=())

    def kinds(self) -> dict[str, str]:
        return dict(f.rsplit(" ", 1) for f in self.fields.split(", "))

    def filled(self, rows: dict[str, Column]) -> Column:
        """The prompt with its {named} places taken by columns."""
        parts = re.split(r"\{(\w+)\}", self.prompt)
        return F.concat(*[F.coalesce(rows[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])

    def items(self, text: str) -> list[dict]:
        """The items of an answer, scalars made lists where lists are asked for; an error if it isn't what was asked."""
        value = json.loads(text)
        if self.keys:
            if isinstance(value, dict):
                value = next((value[k] for k in self.keys if k in value), None)
            if not isinstance(value, list):
                raise ValueError(f"no list of {self.keys[0]}")
        else:
            value = [value]
        out = []
        for v in value:
            if not isinstance(v, dict) or any(v.get(r) in (None, "") for r in self.required):
                raise ValueError(f"an item of {self.name} lacks {', '.join(self.required)}")
            out.append({n: _cast(v.get(n), k) for n, k in self.kinds().items()})
        return out

    def saved(self, text: str) -> str | None:
        """The whole items at the beginning of an answer that was cut."""
        found = next((x for k in self.keys if (x := providers.salvage(text, k))), None)
        return json.dumps({self.keys[0]: found}, ensure_ascii=False) if found else None


def _cast(v: object, kind: str) -> object:
    if kind == "array<string>":
        return providers.as_list(v)
    if v is None:
        return None
    try:
        return int(v) if kind == "long" else float(v) if kind == "double" else str(v)
    except (TypeError, ValueError):
        return None


def asked(rows: DataFrame, contract: Contract, columns: dict[str, Column], provider, model: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, new): rows with item_no and the fields of each item of their answer, and the new rows of the cache.

    A row whose answer has no items has none here. A failed call is an error, gives nothing, or the fallback's items, by
    the contract."""
    keyed = rows.withColumn("__prompt", contract.filled(columns))
    out, new = providers.answered(keyed, "__prompt", contract.name, model, provider, cache, contract.items, contract.saved if contract.salvage else None)
    kinds = contract.kinds()
    arrow = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    carried = rows.columns

    def run(batches):
        for batch in batches:
            take, numbers, found = [], [], []
            for i, answer in enumerate(batch.column("answer").to_pylist()):
                if answer is None and contract.fallback == "error":
                    raise ValueError(f"no valid answer for {contract.name}")
                items = contract.items(answer) if answer is not None else [] if contract.fallback == "empty" else contract.items(contract.fallback)
                take += [i] * len(items)
                numbers += range(len(items))
                found += items
            kept = [batch.column(c).take(pa.array(take, pa.int64())) for c in carried]
            made = [pa.array([x[n] for x in found], arrow[k]) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int64()), *made], [*carried, "item_no", *kinds])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "item_no long", contract.fields])
    return out.select(*carried, "answer").mapInArrow(run, schema), new


_PERSON = f"name, aliases (a list), gender ({GENDERS}), approx_age ({AGE_BANDS}), description, evidence (a list of short quotes)"
_CHARACTER = "name string, aliases array<string>, gender string, approx_age string, description string, evidence array<string>"
CAST_KEYS = ("characters", "cast_of_characters", "cast")

CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        Contract("mentions", f'List everybody who speaks or acts in this chapter. Return JSON "characters": a list with {_PERSON}.\n\n{{text}}', _CHARACTER, CAST_KEYS, "error", True, ("name",)),
        Contract("merges", 'Some entries of this cast may be one person under several names. Return JSON "merges": a list of groups, each with names and canonical.\n\n{cast}', "canonical string, names array<string>", ("merges", "groups", "merge_groups"), "empty"),
        Contract("break", "A chapter is to be cut after one of these numbered paragraphs, where a scene ends. Return JSON with index.\n\n{paragraphs}", "index long", (), '{"index": null}'),
        Contract("boundaries", 'Find the scenes of these numbered paragraphs. Return JSON "scenes": a list with scene_id, location_hint, cast, start_paragraph and end_paragraph.\n\n{paragraphs}', "scene_id string, location_hint string, cast array<string>, start_paragraph long, end_paragraph long", ("scenes",), "error"),
        Contract("beats", 'Cut this scene into narration and dialogue, word for word. Return JSON "beats": a list with type, text, speaker and source_span.\nKnown speakers: {speakers}\n\n{text}', "type string, text string, speaker string, source_span string", ("beats",), "error", False, ("type", "text")),
        Contract("target", "What voice suits this character? Return JSON with gender, age_band, accent and traits.\n\n{name}: {description}", "gender string, age_band string, accent string, traits array<string>", (), "error", False, ("gender", "age_band")),
        Contract("ranking", 'Rank these clips for the character. Return JSON "ranked_choices": a list with clip_id, score and reason.\n\n{name}: {description}\n{clips}', "clip_id string, score double, reason string", ("ranked_choices", "choices"), "empty"),
        Contract("profiles", 'Describe how each of the cast speaks, in 6 to 15 words. Return JSON "profiles": a list with name, voice_descriptor, gender, age_band and accent.\n\n{cast}', "name string, voice_descriptor string, gender string, age_band string, accent string", ("profiles",), "empty", True, ("name",)),
        Contract("cues", 'Give a short cue for the numbered lines that need one. Return JSON "directions": a list with line and cue.\n\n{lines}', "line long, cue string", ("directions",), "empty"),
        Contract("normalise", 'Write these numbered passages as they are spoken. Return JSON "beats": a list with index and text.\n\n{passages}', "index long, text string", ("beats",), "empty"),
        Contract("block", "What is this block: prose, code, table, figure, footnote, equation or drop? Return JSON with kind.\n\n{html}", "kind string", (), '{"kind": "prose"}', False, ("kind",)),
        Contract("structure", 'Cut this part of a script into dialogue, staging and cues, word for word. Return JSON "items": a list with type, speaker and text.\n\n{text}', "type string, speaker string, text string", ("items",), "error", False, ("type",)),
        Contract("roster", 'List the roles of this cast list. Return JSON "entries": a list with name and description.\n\n{text}', "name string, description string", ("entries", "roster"), "error", False, ("name",)),
        Contract("script-characters", f'Complete these speakers as JSON "characters" with {_PERSON}.\n\n{{speakers}}', _CHARACTER, CAST_KEYS, "empty", False, ("name",)),
        Contract("script-directions", 'Give an emotion and a short cue for each numbered line. Return JSON "directions": a list with line, emotion and cue.\n\n{lines}', "line long, emotion string, cue string", ("directions",), "empty"),
    )
}


@dataclass(frozen=True)
class Renderer:
    """A provider of sound: name, what one item is, and the phases that it goes through. Items are asked for until all of
    them are there (finishing.driven); none is skipped."""

    name: str
    item: str
    phases: tuple[str, ...]


RENDERERS = {
    "beat": Renderer("beat", "a prompt and a reference", ("render",)),
    "session": Renderer("session", "a script of several speakers and their references", ("render",)),
    "staged": Renderer("staged", "the chunks of a render plan", ("refs", "ctx", "denoise", "decode")),
}


def rendered(items: DataFrame, provider: Callable[[str, str], bytes], attempts: int = 3) -> DataFrame:
    """(cache_key, sound, failed) of items (cache_key, prompt, ref): a provider's sound, asked for so many times; items
    that still fail are left for the next run."""

    def once(prompt: str, ref: str) -> bytes | None:
        for _ in range(attempts):
            try:
                return provider(prompt, ref)
            except Exception:  # noqa: BLE001, S112 - what fails is asked for again
                continue
        return None

    def run(batches):
        for batch in batches:
            found = [once(p or "", r or "") for p, r in zip(batch.column("prompt").to_pylist(), batch.column("ref").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cache_key"), pa.array(found, pa.binary()), pa.array([f is None for f in found])], ["cache_key", "sound", "failed"])

    return items.select("cache_key", "prompt", "ref").mapInArrow(run, "cache_key string, sound binary, failed boolean")
