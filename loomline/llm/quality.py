"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Emissions read what the line and both of its neighbours look like (quantile bins of letter,
capital, digit and symbol shares, repetition, word lengths and so on; nothing of language or source), transitions
read the label before. The field learns from documents' labels, given to all their lines. A document's score is the
mean of its lines' probabilities of being good, by forward and backward sums, weighted by their lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.hashing import groups_of, mix, texts_of, words
from loomline.llm.sampling import fold, sample_ids
from loomline.llm.shared import only, sparing

SAMPLE = 5000  # labelled documents that the field is learned from, at most
SEGMENT = 64  # lines in a row of which learning sees the chain
LINES = 8 * SEGMENT  # lines of one document that the field is learned from, at most: segments spread over all of it
BINS = 8
THRESHOLD = 0.3
EMPTY = 0.0  # the score of a text without a line
FEATURES = ("length", "letters", "capitals", "digits", "symbols", "stops", "marks", "spaces", "word", "distinct", "again", "suffix")

_kind = np.zeros((7, 256), bool)
_kind[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True  # letters
_kind[1, [*range(65, 91)]] = True  # capitals
_kind[2, [*range(48, 58)]] = True  # digits
_kind[3, [c for c in range(33, 127) if chr(c) in "#$%&*+/<=>@\\^_`{|}~[]"]] = True  # symbols
_kind[4, [ord(c) for c in ".,;:"]] = True  # stops
_kind[5, [ord(c) for c in "!?|\"'()-"]] = True  # marks
_kind[6, [9, 11, 12, 13, 32]] = True  # spaces


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word, their lengths in bytes, and where each text's lines begin among them."""
    cuts = np.flatnonzero(raw == 10)
    begins = np.unique(np.concatenate([at[:-1], cuts + 1])) if len(raw) else np.zeros(0, np.int64)
    begins = begins[begins < len(raw)]
    if not len(begins):
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(len(at), np.int64)
    ends = np.append(begins[1:], len(raw))
    word, start, end, _ = words(raw, at)
    first = np.searchsorted(start, begins)
    n_words = np.diff(np.append(first, len(start)))
    full = n_words > 0
    begins, ends, first, n_words = begins[full], ends[full], first[full], n_words[full]
    if not len(begins):
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(len(at), np.int64)
    size = (ends - begins).astype(float)
    # bytes between the last kept line and the next count to the line before them: white space only
    sums = [np.add.reduceat(k[raw], begins).astype(float) for k in _kind]
    ascii_letters = np.maximum(1.0, np.add.reduceat(_kind[0][raw] & (raw < 128), begins).astype(float))
    line = np.repeat(np.arange(len(begins)), n_words)
    keys = np.sort(mix(word ^ mix(line.astype(np.uint64))) >> np.uint64(20) | (line.astype(np.uint64) << np.uint64(44)))
    fresh = np.append(True, keys[1:] != keys[:-1])
    distinct = np.bincount((keys[fresh] >> np.uint64(44)).astype(np.int64), minlength=len(begins)) / n_words
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    again = np.add.reduceat(same, first) / n_words
    odd = _kind[3][raw[end - 1]] | (raw[end - 1] == 33)
    suffix = np.add.reduceat(odd, first) / n_words
    spread = distinct * np.minimum(1.0, np.log1p(n_words) / 3)
    columns = [np.log1p(size), sums[0] / size, sums[1] / ascii_letters, *(s / size for s in sums[2:7]), np.log1p(size / n_words), spread, again, suffix]
    return np.stack(columns, axis=1), size, np.searchsorted(begins, at)


def bins_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For every line, the weights' places of its own bins and of both neighbours' (rows of one text in a row)."""
    f = x.shape[1]
    own = np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(f)], axis=1)
    return own + np.arange(f) * BINS


def with_neighbours(own: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of the line, the line before and the line after; where there is none, a place of its own."""
    f = own.shape[1] * BINS
    none = np.full((1, own.shape[1]), -1)
    before, after = np.concatenate([none, own[:-1]]) + f, np.concatenate([own[1:], none]) + 2 * f
    starts = begin[:-1][np.diff(begin) > 0]
    stops = begin[1:][np.diff(begin) > 0] - 1
    before[starts], after[stops] = 3 * f, 3 * f + 1
    return np.concatenate([own, before, after], axis=1)


def _forward(e: np.ndarray, t: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log odds of good given what comes up to each line. Chains run side by side, longest first."""
    a = np.empty(len(e))
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    active = int((lengths > 0).sum())
    now = e[begin[:active]].copy()
    a[begin[:active]] = now
    for k in range(1, int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -k, "left"))
        now = now[:active]
        now = e[begin[:active] + k] + np.logaddexp(now + t[1, 1], t[0, 1]) - np.logaddexp(now + t[1, 0], t[0, 0])
        a[begin[:active] + k] = now
    return a


def marginals(e: np.ndarray, t: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds forward and backward of every line (backward without the line itself), and the odds of both."""
    lengths = np.diff(begin)
    a = _forward(e, t, lengths, begin[:-1])
    mirror = _forward(e[::-1], t.T, lengths[::-1], len(e) - begin[1:][::-1])[::-1]
    return a, mirror - e, a + mirror - e


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Field:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
        self.edges, self.weights, self.transitions = edges, weights, transitions

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, raw, at in groups_of(*texts_of(column)):
            x, size, begin = line_features(raw, at)
            good = np.full(len(at) - 1, EMPTY)
            if len(x):
                e = self.weights[with_neighbours(bins_of(x, self.edges), begin)].sum(axis=1)
                p = _sigmoid(marginals(e, self.transitions, begin)[2])
                some = np.flatnonzero(np.diff(begin) > 0)
                total = np.add.reduceat(p * size, begin[some]) / np.add.reduceat(size, begin[some])
                good[some] = np.clip(total, 0.0, 1.0)
            out.append(good)
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: list[tuple[np.ndarray, int]], steps: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """A field from (features of the lines, label) of documents, by gradient ascent (Adam) on the likelihood."""
    x = np.concatenate([d for d, _ in docs])
    edges = np.stack([np.quantile(x[:, j], np.arange(1, BINS) / BINS) for j in range(x.shape[1])])
    begin = np.concatenate([[0], np.cumsum([len(d) for d, _ in docs])])
    places = with_neighbours(bins_of(x, edges), begin)
    labels = np.repeat(np.array([y for _, y in docs], float), np.diff(begin))
    cut = np.unique(np.concatenate([np.arange(b, e, SEGMENT) for b, e in zip(begin[:-1], begin[1:], strict=True)] + [begin[-1:]])).astype(np.int64)
    # every document weighs the same, whatever its number of lines
    weight = np.repeat(1 / np.maximum(1, np.diff(begin)), np.diff(begin))
    inner = np.ones(len(x), bool)
    inner[cut[1:] - 1] = False
    inner = np.flatnonzero(inner)
    width = 3 * x.shape[1] * BINS + 2
    params, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, steps + 1):
        w, t = params[:width], params[width:].reshape(2, 2)
        e = w[places].sum(axis=1)
        a, b, both = marginals(e, t, cut)
        gap = (labels - _sigmoid(both)) * weight
        g = np.empty_like(params)
        g[:width] = np.bincount(places.ravel(), np.repeat(gap, places.shape[1]), width)
        nxt = e[inner + 1] + b[inner + 1]
        z = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] + nxt, t[1, 0] + a[inner], t[1, 1] + a[inner] + nxt])
        z = np.exp(z - z.max(axis=0))
        pair = (z / z.sum(axis=0) * weight[inner]).sum(axis=1).reshape(2, 2)
        seen = np.array([[((1 - labels[inner]) * weight[inner]).sum(), 0.0], [0.0, (labels[inner] * weight[inner]).sum()]])
        g[width:] = (seen - pair).ravel()
        g = g / len(docs) - penalty * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(edges, params[:width], params[width:].reshape(2, 2))


def _spread(x: np.ndarray) -> np.ndarray:
    """All lines of a document, or of a longer one LINES in segments at equal distances from its first to its last."""
    if len(x) <= LINES:
        return x
    begins = np.linspace(0, len(x) - SEGMENT, LINES // SEGMENT).astype(np.int64)
    return np.concatenate([x[b : b + SEGMENT] for b in begins])


def _lines(batches):
    for batch in batches:
        rows = []
        for _, _, raw, at in groups_of(*texts_of(batch.column("text"))):
            x, _, begin = line_features(raw, at)
            rows += [_spread(x[b:e]).astype(np.float32).tobytes() for b, e in zip(begin[:-1], begin[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "lines"])


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from documents outside of fold 0 with a label: at most sample of them, chosen by their doc_id's hash, and
    at most LINES lines of each, so that the driver gets no more than sample * LINES rows of features. None if not both labels are there. Of several labels of one doc_id the lower counts."""
    labels = only(labels, "doc_id", "quality").where((fold() != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = sample_ids(labels, sample)
    marks = {r.doc_id: r.quality for r in labels.join(F.broadcast(ids), "doc_id").collect()}  # at most sample rows
    texts = only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    rows = texts.mapInArrow(sparing(_lines), "doc_id long, lines binary").toArrow().to_pylist()
    rows = sorted((r["doc_id"], r["lines"]) for r in rows if r["lines"])
    data = [(np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(float), marks[d]) for d, x in rows]
    return fit(data) if len({y for _, y in data}) == 2 else None


def scored(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score and predicted for every row of docs (doc_id, text). Null texts and those without words score
    EMPTY; without a field every text with words scores 1. Repeated rows stay; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            if shared.value is None:
                score = np.array([float(bool((t or "").split())) for t in column.to_pylist()])
            else:
                score = shared.value.scores(column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(sparing(run), "doc_id long, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores for all of docs by a field of labelled documents outside of fold 0, with held_out (fold 0) beside them;
    held_out is false for rows without a doc_id."""
    held = F.coalesce(fold() == 0, F.lit(False))
    return scored(docs, learned(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose text is predicted to be of bad quality.

    Null texts and those without words score EMPTY and so are rejected. Repeated rows stay or go together. Without both
    labels among the labelled documents there is no field, and every row with words stays. An empty table stays empty.
    """
    field = learned(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        column = pa.array(texts, pa.string())
        return pd.Series(shared.value.scores(column) if shared.value is not None else [1.0 if (t or "").split() else 0.0 for t in column.to_pylist()])

    return docs.where(score(F.col("text").cast("string")) >= THRESHOLD)
