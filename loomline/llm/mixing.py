"""Mixing documents to target domain weights by soft membership.

A multinomial logistic classifier, learned from a labelled table, gives every document posteriors over the domains.
Then nonnegative rates are fitted, one per document, so that the expected tokens of each domain,
sum of rate * tokens * posterior, match the targets: least squares by accelerated projected gradient from rates of 1,
which starts its acceleration anew where it would overshoot. The gradient of a document's rate is its posterior times
one vector with an entry per domain, so a step is one aggregation of 2 * D + 1 sums over a narrow table, and a rate is
the fold of a document's posterior over the steps' vectors; every FOLD steps the rates are written, so that a step's
cost doesn't grow with their number. The residual is measured in the metric of the domains' token cross-moments, in
which full steps converge.
"""

from __future__ import annotations

import logging
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.hashing import groups_of, mix, texts_of, words
from loomline.llm.linear import fit, softmax
from loomline.llm.sampling import sample_ids
from loomline.llm.shared import only, sparing, written

WIDTH = 1 << 17
SAMPLE = 6000  # labelled documents that the classifier is learned from, at most
STEPS = 40
FOLD = 8
STILL = 0.95  # the steps also end where FOLD of them leave more than this share of the residual
CLOSE = 1e-4  # the steps end when no domain's tokens are further from its target than this share of all


def _features(raw: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text, the places of its words and of its words' last two bytes, and the place WIDTH if many words repeat
    the one before."""
    word, _, end, own = words(raw, at)
    last = raw[end - 1].astype(np.uint64) << np.uint64(8) | raw[np.maximum(end - 2, 0)].astype(np.uint64)
    tail = mix(last + np.uint64(1 << 40)) >> np.uint64(47)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    place = word >> np.uint64(47)
    out = []
    for b, e in zip(own[:-1], own[1:], strict=True):
        parts = [place[b:e], tail[b:e]]
        if again[b + 1 : e].mean() > 0.3 if e - b > 1 else False:
            parts.append(np.array([WIDTH], np.uint64))
        out.append(np.unique(np.concatenate(parts)).astype(np.int64))
    return out, np.diff(own)


def _each(column: pa.Array):
    for _, _, raw, at in groups_of(*texts_of(column)):
        places, n = _features(raw, at)
        yield from zip(places, n.tolist(), strict=True)


def _sampled(batches):
    for batch in batches:
        found = [p.astype(np.int32).tobytes() for p, _ in _each(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "places"])


class Domains:
    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.names, self.weights, self.bias, self.temperature = names, weights, bias, temperature

    def posterior(self, places: np.ndarray) -> np.ndarray:
        if not self.names:
            return np.zeros(0)
        return softmax((self.weights[places].sum(axis=0) + self.bias) / self.temperature)


def learned(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Domains:
    """A classifier from labelled (doc_id, domain), by at most sample of its documents chosen by their doc_id's hash.
    Of several domains of a doc_id the first counts; rows with a null doc_id or domain don't."""
    labelled = only(labelled, "doc_id", "domain").where("domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = sample_ids(labelled, sample)
    marks = {r.doc_id: r.domain for r in labelled.join(F.broadcast(ids), "doc_id").collect()}  # at most sample rows
    texts = only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    rows = sorted({(r["doc_id"], r["places"]) for r in texts.mapInArrow(sparing(_sampled), "doc_id long, places binary").toArrow().to_pylist()}, key=lambda r: (mix(np.array([r[0]], np.int64).view(np.uint64))[0], r[1]))
    names = sorted({marks[d] for d, _ in rows})
    data = []
    for doc, places in rows:
        p = np.frombuffer(places, np.int32).astype(np.int64)
        data.append((p, np.ones(len(p)), names.index(marks[doc])))
    if not data:
        return Domains(names, np.zeros((WIDTH + 1, 0)), np.zeros(0), 1.0)
    return Domains(names, *fit(data, WIDTH + 1, len(names), epochs=4, alpha=0.1, l1=1.0, l2=0.01))


def memberships(docs: DataFrame, domains: Domains) -> DataFrame:
    """doc_id, tokens (white-space words) and posteriors of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(domains)

    def run(batches):
        for batch in batches:
            found = [(shared.value.posterior(p), n) for p, n in _each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in found], pa.int64()), pa.array([p.tolist() for p, _ in found], pa.list_(pa.float64()))], ["doc_id", "tokens", "posterior"])

    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(sparing(run), "doc_id long, tokens long, posterior array<double>")


def _after(steps: list[list[float]]) -> F.Column:
    """A row's state after further steps, as an expression of its state and posterior: its rate, the point ahead of it
    from which the next step goes, and how far the last step turned back. A step is a gradient's vector, how far to look
    ahead, and whether to go from the rate itself."""
    if not steps:
        return F.col("state")
    d = len(steps[0]) - 2

    def step(s, g):
        begin = F.when(g[d + 1] > 0, s["rate"]).otherwise(s["ahead"])
        dot = F.aggregate(F.zip_with("posterior", F.slice(g, 1, d), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        moved = F.struct(F.greatest(F.lit(0.0), begin - dot).alias("rate"), begin.alias("begin"), s["rate"].alias("old"), g[d].alias("far"))
        # an array of one, so that the new rate is computed once
        return F.transform(F.array(moved), lambda m: F.struct(m["rate"].alias("rate"), (m["rate"] + m["far"] * (m["rate"] - m["old"])).alias("ahead"), ((m["begin"] - m["rate"]) * (m["rate"] - m["old"])).alias("turn")))[0]

    return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps]), F.col("state"), step)


class Fit(NamedTuple):
    members: DataFrame  # with their rates
    aim: np.ndarray  # tokens by domain
    reached: np.ndarray
    close: bool


def fitted(members: DataFrame, targets: list[float], grow: bool = False) -> Fit:
    """members with a rate, the tokens aimed at and those reached by domain, and whether these are close. targets are
    shares, made to sum to 1.

    The tokens aimed at sum to those there are; with grow, to the fewest at which no domain has to lose any. Domains
    without any token keep a target of none. Targets out of reach end near the least squares.
    """
    d = len(targets)
    p = [F.col("posterior")[i] for i in range(d)]
    t = F.col("tokens").cast("double")
    members = members.withColumn("state", F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"), F.lit(0.0).alias("turn")))

    def done(now: DataFrame, aim: np.ndarray, reached: np.ndarray, close: bool) -> Fit:
        return Fit(now.withColumn("rate", F.col("state.rate")).drop("state"), aim, reached, close)

    row = members.agg(*[F.sum(t * p[i]) for i in range(d)], *[F.sum(t * p[i] * p[j]) for i in range(d) for j in range(d)]).first() if d else []
    have, moments = np.array([x or 0.0 for x in row[:d]]), np.array([x or 0.0 for x in row[d:]]).reshape(d, d)
    share = np.where(have > 0, np.array(targets, float), 0.0)
    if not have.sum() or not share.sum():
        return done(members, have, have, True)
    share = share / share.sum()
    total = max(h / s for h, s in zip(have, share, strict=True) if s > 0) if grow else have.sum()
    aim, now, ahead = share * total, have, have
    metric = np.linalg.pinv(moments, rcond=1e-9)
    steps: list[list[float]] = []
    inertia, fresh, left = 1.0, True, []
    for k in range(STEPS):
        gap = now - aim
        left.append(float(np.sqrt(gap @ metric @ gap)))
        if np.abs(gap).max() <= CLOSE * total or k >= FOLD and min(left) > STILL * min(left[:-FOLD]):
            break
        before, inertia = inertia, (1 + np.sqrt(1 + 4 * inertia * inertia)) / 2
        steps.append([*(metric @ ((now if fresh else ahead) - aim)).tolist(), (before - 1) / inertia, float(fresh)])
        if len(steps) > FOLD:
            members, steps = written(members.withColumn("state", _after(steps[:-1])), "members"), steps[-1:]
        rows = members.select("tokens", "posterior", _after(steps).alias("state"))
        row = rows.agg(*[F.sum(F.col(f"state.{c}") * t * p[i]) for c in ("rate", "ahead") for i in range(d)], F.sum(F.col("state.turn") * t)).first()
        now, ahead, fresh = np.array(row[:d]), np.array(row[d : 2 * d]), row[-1] > 0
        inertia = 1.0 if fresh else inertia
    return done(members.withColumn("state", _after(steps)), aim, now, bool(np.abs(now - aim).max() <= CLOSE * total))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], grow: bool = False, at_least: int = 0) -> DataFrame:
    """doc_id, tokens, rate, copies and p_<domain> of every row of docs (doc_id, text).

    targets gives shares by domain; domains without one have none. Where the targets can't be reached, a warning says
    what was. copies is the rate rounded up or down by the doc_id's hash, so that its mean is the rate, but no less than
    at_least. Null and empty texts have no tokens, the classifier's prior as posterior, and a rate like any other's.
    Without any labelled row there are no domains, and every rate is 1. Repeated rows stay and are alike; an empty
    table gives no rows; other columns are ignored.
    """
    domains = learned(docs, labelled)
    members = written(memberships(docs, domains), "members")
    fit_ = fitted(members, [targets.get(n, 0.0) for n in domains.names], grow)
    if not fit_.close:
        logging.getLogger(__name__).warning("mixture targets out of reach: %s", {n: (round(a), round(r)) for n, a, r in zip(domains.names, fit_.aim, fit_.reached, strict=True)})
    chance = (F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    out = fit_.members.withColumn("copies", F.greatest(F.lit(at_least), F.floor(F.col("rate") + chance)).cast("long"))
    return out.select("doc_id", "tokens", "rate", "copies", *[F.col("posterior")[i].alias(f"p_{n}") for i, n in enumerate(domains.names)])


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from labels (doc_id, quality, toxic): poor, toxic or clean."""
    labels = only(labels, "doc_id", "quality", "toxic").where("quality is not null")
    return labels.select("doc_id", F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))
