"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Documents carry labels, tokens don't, so the tokens of a bounded, stratified sample of
labelled rows are labelled first: in a toxic document, those with a feature that toxic
documents have far more often.  The field (two states, hashed word and prefix features,
transitions) is fitted to them by maximum likelihood.  Forward-backward gives every token of
every text its marginal; their sum, maximum and share, calibrated by a logistic regression
on sampled documents that the field has not seen, give the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textops import U64, Words, pieces

#: Labelled rows of each class that the model is fitted to, at most; the lowest hashes of their ids.
SAMPLE_PER_CLASS = 1000
#: Byte lengths of the prefix features; the whole word comes first.
PREFIXES = (4, 6, 8)
_FILTER_BITS = 18
_SEGMENT = 512


def features(words: Words) -> list[np.ndarray]:
    return [words.hash, *(words.prefix_hash(n) for n in PREFIXES)]


def forward_backward(odds: np.ndarray, first: np.ndarray, step: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probability of state 1 for each token, and the expected transition counts.

    ``odds``: emission odds of state 1; ``first``: offsets of the texts; ``step``: 2 x 2
    transition factors.  Both passes carry odds, so one number a text, and move all texts
    on by one token at a time, longest first.
    """
    size = np.diff(first)
    longest = np.argsort(-size, kind="stable")
    start, size = first[:-1][longest], size[longest]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    ahead, behind = np.empty(len(odds)), np.ones(len(odds))
    for t in range(steps):
        at = start[:active[t]] + t
        if t == 0:
            r = odds[at]
        else:
            r = r[:active[t]]
            r = odds[at] * (step[0, 1] + step[1, 1] * r) / (step[0, 0] + step[1, 0] * r)
        ahead[at] = r
    for t in range(steps - 2, -1, -1):
        at = start[:active[t + 1]] + t
        x = odds[at + 1] * behind[at + 1]
        behind[at] = (step[1, 0] + step[1, 1] * x) / (step[0, 0] + step[0, 1] * x)
    both = ahead * behind
    expected = np.zeros((2, 2))
    if pairs:
        inner = np.ones(len(odds), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)
        r, x = ahead[at - 1], odds[at] * behind[at]
        cells = np.stack([np.full(len(at), step[0, 0]), step[0, 1] * x, r * step[1, 0], r * step[1, 1] * x])
        expected = (cells / cells.sum(0)).sum(1).reshape(2, 2)
    return both / (1 + both), expected


@dataclass
class Model:
    keys: np.ndarray  # ascending hashes of the features with a weight
    weights: np.ndarray
    bias: float
    steps: np.ndarray  # log transition weights
    calibration: np.ndarray  # of the document's score

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.keys >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def emissions(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(found[0]), self.bias)
        for hashes in found if len(self.keys) else ():
            at = np.flatnonzero(self.maybe[(hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            out[at] += np.where(self.keys[place] == hashes[at], self.weights[place], 0.0)
        return out

    def marginals(self, words: Words) -> np.ndarray:
        odds = np.exp(np.clip(self.emissions(features(words)), -30, 30))
        return forward_backward(odds, words.first, np.exp(self.steps))[0]

    def scores(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = np.clip(_document_features(marginals, first) @ self.calibration, -30, 30)
        return 1 / (1 + np.exp(-z))


def _document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Constant, log of the expected toxic tokens, largest marginal, share of toxic tokens."""
    size = np.diff(first)
    total, most = np.zeros(len(size)), np.zeros(len(size))
    full = np.flatnonzero(size)
    if len(full):
        total[full] = np.add.reduceat(p, first[:-1][full])
        most[full] = np.maximum.reduceat(p, first[:-1][full])
    share = total / np.maximum(size, 1)
    return np.stack([np.ones(len(size)), np.log1p(total), most, np.log1p(100 * share)], 1)


def _evidence(found: list[np.ndarray], doc: np.ndarray, toxic: np.ndarray, ratio: float, deviations: float) -> tuple[np.ndarray, np.ndarray]:
    """Features that toxic documents have ``ratio`` times as often, and by ``deviations`` standard deviations more often
    than chance would let them, and their ratios."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    keys, ratios = [], []
    for hashes in found:
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        distinct, at = np.unique(h, return_inverse=True)
        in1 = np.bincount(at, weights=toxic[d], minlength=len(distinct))
        in0 = np.bincount(at, minlength=len(distinct)) - in1
        r = ((in1 + 0.5) / (n1 + 1)) / ((in0 + 0.5) / (n0 + 1))
        share = (in1 + in0) / (n1 + n0)
        sure = (in1 / n1 - in0 / n0) >= deviations * np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        kept = sure & (r >= ratio)
        keys.append(distinct[kept])
        ratios.append(r[kept])
    keys, ratios = np.concatenate(keys), np.concatenate(ratios)
    distinct, at = np.unique(keys, return_index=True)
    return distinct, ratios[at]


def fit(texts: pa.Array, toxic: np.ndarray, class_weights: tuple[float, float], ratio: float = 3.0, deviations: float = 3.0,
        label_ratio: float = 6.0, rounds: int = 60, penalty: float = 1e-3) -> Model:
    """Model from labelled texts; ``class_weights`` undo the stratified sampling in the calibration.

    Three of five documents fit the field, the others its calibration.  Without both classes
    the model is the prior alone: 0 without labels.
    """
    prior = toxic.sum() * class_weights[1] / max(1e-9, toxic.sum() * class_weights[1] + (~toxic).sum() * class_weights[0])
    flat = Model(np.zeros(0, U64), np.zeros(0), -30.0, np.zeros((2, 2)),
                 np.array([np.log((prior + 1e-6) / (1 - prior + 1e-6)), 0, 0, 0]))
    own = np.arange(len(toxic)) % 5 < 3
    if toxic[own].sum() < 2 or (~toxic[own]).sum() < 2 or toxic[~own].sum() < 2 or (~toxic[~own]).sum() < 2:
        return flat
    words = [Words(data, offsets) for _, _, data, offsets in pieces(texts.take(pa.array(np.flatnonzero(own))))]
    sizes = np.concatenate([w.count() for w in words])
    found = [np.concatenate(x) for x in zip(*(features(w) for w in words), strict=True)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keys, ratios = _evidence(found, doc, toxic[own], ratio, deviations)
    if not len(keys):
        return flat
    # Of each kind of feature, only the tokens whose feature has a weight are kept.
    slots, place, strong = [], [], np.zeros(len(doc), bool)
    for kind in range(len(found)):
        h, found[kind] = found[kind], None
        p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        s = np.flatnonzero(keys[p] == h)
        slots.append(s.astype(np.int32))
        place.append(p[s].astype(np.int32))
        strong[s[ratios[p[s]] >= label_ratio]] = True
    del words, h, p, s
    label = toxic[own][doc] & strong
    # For the fit alone, texts are read in segments, all side by side.
    cuts = np.unique(np.concatenate((np.cumsum(sizes), [0], np.arange(0, len(doc), _SEGMENT))))
    first = cuts[cuts <= len(doc)]
    inner = np.ones(len(doc), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(2 * label[at - 1] + label[at], minlength=4).reshape(2, 2).astype(float)
    theta = np.concatenate((np.zeros(len(keys)), [-4.0], [0.0, 0.0, 1.0]))  # weights, bias, steps 01, 10, 11
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        e = np.full(len(doc), theta[len(keys)])
        for s, p in zip(slots, place, strict=True):
            e[s] += theta[p]
        step = np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))
        p1, pair = forward_backward(np.exp(np.clip(e, -30, 30)), first, step, pairs=True)
        miss = p1 - label
        grad = np.zeros_like(theta)
        for s, p in zip(slots, place, strict=True):
            grad[:len(keys)] += np.bincount(p, weights=miss[s], minlength=len(keys))
        grad[len(keys)] = miss.sum()
        grad[-3:] = (pair - seen).ravel()[1:]
        grad = grad / len(toxic) + penalty * theta * (np.arange(len(theta)) < len(keys))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.25 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        theta[-3:] = np.clip(theta[-3:], -6, 6)
    model = Model(keys, theta[:len(keys)], float(theta[len(keys)]),
                  np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]), flat.calibration)
    rest = np.flatnonzero(~own)
    x = np.concatenate([_document_features(model.marginals(w), w.first)
                        for w in (Words(d, o) for _, _, d, o in pieces(texts.take(pa.array(rest))))])
    model.calibration = _logistic(x, toxic[rest].astype(float), np.where(toxic[rest], class_weights[1], class_weights[0]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.5, rounds: int = 50) -> np.ndarray:
    b = np.zeros(x.shape[1])
    ridge = penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ b
        move = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(b)), grad)
        b = b - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return b


def held_out(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """Rows whose labels are never learnt from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits the model to at most ``per_class`` labelled rows of each class.

    Labels of held-out ids are not read.  An id labelled twice is toxic if either label is;
    null ids and null labels are left out.  Only the sample reaches the driver.
    """
    known = (labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    counts = {bool(x["toxic"]): x["count"] for x in known.groupBy(F.col("toxic") > 0).count().toDF("toxic", "count").collect()}
    lowest = [known.filter((F.col("toxic") > 0) == F.lit(kind)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
              for kind in (False, True)]
    sample = lowest[0].unionByName(lowest[1]).withColumnRenamed("doc_id", "_id")  # 2 * per_class rows at most
    table = (docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").toArrow())
    toxic = table["toxic"].to_numpy() > 0
    weights = tuple(counts.get(kind, 0) / max(1, int((toxic == kind).sum())) for kind in (False, True))
    texts = table["text"].combine_chunks() if table["text"].num_chunks else pa.array([], pa.string())
    return fit(texts, toxic, weights)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _spans(words: Words, data: np.ndarray, offsets: np.ndarray, p: np.ndarray, least: float) -> list[list[dict]]:
    """Runs of tagged words of each text: code point offsets, and the largest marginal."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    tagged = np.flatnonzero(p >= least)
    if not len(tagged):
        return out
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    text = np.searchsorted(words.first, tagged, "right") - 1
    breaks = np.flatnonzero((np.diff(tagged) > 1) | (np.diff(text) > 0)) + 1
    for run, i in zip(np.split(tagged, breaks), text[np.r_[0, breaks]], strict=True):
        base = chars[offsets[i]]
        out[i].append({"start": int(chars[words.start[run[0]]] - base), "end": int(chars[words.end[run[-1]]] - base),
                       "p": float(p[run].max())})
    return out


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, span_threshold: float = 0.5) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``spans`` (offending offsets).

    Null and empty texts score as texts without evidence; equal texts score alike; every row
    stays; columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted", "spans")
    extra = "score double, predicted int, spans array<struct<start: int, end: int, p: double>>"
    schema = StructType([*docs.schema.fields, *docs.sparkSession.createDataFrame([], extra).schema.fields])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = [], []
            for _, _, data, offsets in pieces(b.column(names.index(text))):
                words = Words(data, offsets)
                p = model.marginals(words)
                scores.append(model.scores(p, words.first))
                spans += _spans(words, data, offsets, p, span_threshold)
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, _SPANS)],
                names=[*names, "score", "predicted", "spans"])

    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, columns unchanged; null and empty texts score like clean ones."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for _, _, data, offsets in pieces(b.column(at)):
                words = Words(data, offsets)
                kept.append(model.scores(model.marginals(words), words.first) < threshold)
            yield b.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
