"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to 3 code points of the lower-cased text, in which whatever isn't a letter counts as one blank, are hashed
into WIDTH places. Inverse document frequencies count every training document; the regression learns from a bounded
sample of them by follow-the-regularised-leader with an elastic net, and a temperature calibrates its probabilities.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.hashing import mix
from loomline.llm.linear import fit, softmax
from loomline.llm.sampling import fold, sample_ids
from loomline.llm.shared import only

WIDTH = 1 << 16
SAMPLE = 4000  # documents that the weights are learned from, at most
UNKNOWN = "und"
_STEP = 1 << 18
_letters = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's n-grams, rising, and how often each is there; none for a text without letters."""
    counts = None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    for begin in range(0, len(codes), _STEP):
        part = codes[max(0, begin - 2) : begin + _STEP]
        fresh = min(begin, 2)  # what of the part the step before has counted
        letter = letters()[part]
        if not letter.any():
            continue
        c = np.where(letter, part, 32).astype(np.uint64)
        found = []
        for n in (1, 2, 3):
            h = c[: len(c) - n + 1].copy()
            some = letter[: len(c) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - n + 1 + k]
                some |= letter[k : len(c) - n + 1 + k]
            skip = max(0, fresh - n + 1)
            found.append((mix(h + np.uint64(n << 40)) >> np.uint64(48))[skip:][some[skip:]])
        add = np.bincount(np.concatenate(found).astype(np.int64), minlength=WIDTH)
        counts = add if counts is None else counts + add
    if counts is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.flatnonzero(counts)
    return places, counts[places]


def tf_idf(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[places]
    length = np.sqrt((v * v).sum())
    return v / length if length else v


def _frequencies(batches):
    total = np.zeros(WIDTH, np.int64)
    rows = 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            places, _ = ngrams(text or "")
            total[places] += 1
            rows += 1
    if rows:
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(total[places], rows))], ["place", "n"])


def _vectors(batches):
    for batch in batches:
        found = [ngrams(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array([p.astype(np.uint16).tobytes() for p, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())],
            ["doc_id", "lang", "places", "counts"],
        )


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        places, counts = ngrams(text or "")
        if not len(places) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax((tf_idf(places, counts, self.idf) @ self.weights[places] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def learned(training: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from every row of training (doc_id, text, lang) with a language. Frequencies count all of its rows; the
    weights are of at most sample documents. Texts without letters teach nothing; no rows give a model that answers
    UNKNOWN. The tables brought to the driver are WIDTH rows, and the sample's counts."""
    training = only(training, "doc_id", "text", "lang").where("lang is not null")
    counted = training.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(WIDTH)
    total = 0
    for place, n in zip(counted.column("place").to_pylist(), counted.column("n").to_pylist(), strict=True):
        if place < 0:
            total = n
        else:
            df[place] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    chosen = training.join(F.broadcast(sample_ids(training, sample)), "doc_id", "left_semi")
    rows = chosen.select("doc_id", "text", "lang").mapInArrow(_vectors, "doc_id long, lang string, places binary, counts binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["places"]), key=lambda r: (mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0], r["lang"], r["places"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], idf, np.zeros((WIDTH, 0)), np.zeros(0), 1.0)
    data = []
    for r in rows:
        places = np.frombuffer(r["places"], np.uint16).astype(np.int64)
        data.append((places, tf_idf(places, np.frombuffer(r["counts"], np.uint32), idf), languages.index(r["lang"])))
    return Model(languages, idf, *fit(data, WIDTH, len(languages), epochs=2, alpha=1.0, l1=1e-4, l2=1e-5))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs (doc_id, text): null texts and those without a letter are
    UNKNOWN with score 0; repeated rows stay, and equal texts have equal answers. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Predictions for all of docs by a model of those outside of fold 0, with held_out (fold 0) beside them. Rows
    without a doc_id are predicted but teach nothing; held_out is false for them."""
    model = learned(docs.where(fold() != 0))
    held = F.coalesce(fold() == 0, F.lit(False))
    return predicted(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
