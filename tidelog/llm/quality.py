"""A quality classifier learned from positive and unlabelled texts.

Trusted positives are texts marked good; the unlabelled are web texts at large. A linear model of
style features of the whole text minimises the non-negative unbiased risk: with class prior p,
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)) under the logistic loss; where the
second part falls below zero, the step goes the other way. The prior is estimated from how many
of the unlabelled score like positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import keep_only, sampled, tidy

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\v\f", ".", ",;:", "!", "?", "'\"`", "|", "#$%&*@^~", "()[]{}<>", "-_/\\+=")
N_CLASSES = len(_GROUPS) + 2
_CLASS = np.zeros(256, np.int64)
for _i, _group in enumerate(_GROUPS):
    _CLASS[np.frombuffer(_group.encode(), np.uint8)] = _i + 1
_CLASS[128:] = N_CLASSES - 1
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 5


def features(column) -> np.ndarray:
    """Style features of whole texts, a row each: byte classes and pairs of them per byte, and repetition of words.

    An empty text has zeros. No feature depends on the language's words or on the text's length.
    """
    data, off = textvec.utf8(column)
    out = np.zeros((len(off) - 1, N_FEATURES), np.float32)
    square = N_CLASSES * N_CLASSES
    for a, b in textvec.chunks(off):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        cls = _CLASS[part]
        pairs = cls[:-1] * N_CLASSES + cls[1:]
        hashes, words = textvec.word_hashes(part, at)
        for i in range(b - a):
            x, y, row = at[i], at[i + 1], out[a + i]
            if x == y:
                continue
            row[:N_CLASSES] = np.bincount(cls[x:y], minlength=N_CLASSES) / (y - x)
            row[N_CLASSES : N_CLASSES + square] = np.bincount(pairs[x : y - 1], minlength=square) / (y - x)
            h = hashes[words[i] : words[i + 1]]
            n = len(h)
            if n > 1:
                s = np.sort(h)
                row[-5] = np.mean(h[1:] == h[:-1])
                row[-4] = np.mean(h[2:] == h[:-2]) if n > 2 else 0
                runs = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
                row[-3] = np.sum((runs / n) ** 2) - 1 / n
            if n >= 5:
                run = np.unique(next(textvec.shingles(h, np.array([0, n]), 5)))
                row[-2] = 1 - len(run) / (n - 4)
            row[-1] = n / (y - x)
    return np.log1p(200 * out)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6) @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(w: np.ndarray, x: np.ndarray, n: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights and bias ``w`` over x, of which the first n rows are the positives, and the direction of its descent.

    Where the part of the negatives falls below zero it counts as zero, and the direction raises it.
    """
    m = len(x) - n
    z = x @ w[:-1] + w[-1]
    p = _sigmoid(z)
    loss = np.logaddexp(0, z)  # of calling it negative
    negative = loss[n:].mean() - prior * loss[:n].mean()
    d = np.zeros(n + m)
    if negative >= 0:
        d[:n] = prior * (p[:n] - 1) / n - prior * p[:n] / n
        d[n:] = p[n:] / m
    else:
        d[:n] = prior * p[:n] / n
        d[n:] = -p[n:] / m
    return prior * (loss[:n] - z[:n]).mean() + max(0.0, negative), np.append(x.T @ d, d.sum())


def minimise(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk (Adam on the whole sample; no randomness)."""
    x = np.vstack([pos, unl])
    w = np.zeros(x.shape[1] + 1)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = risk(w, x, len(pos), prior)[1] + decay * np.append(w[:-1], 0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.2) -> float:
    """Share of positives among the unlabelled, from scores of both by a model that tells them apart.

    Above any threshold the unlabelled are at least prior times as many as the positives; where
    only positives score, just so many. The estimate is the smallest ratio over thresholds that keep
    at least the ``least`` share of the positives. Its noise makes it a little too small, which costs
    less than too large a prior: the risk then calls a few more texts negative, not too few.
    """
    cuts = np.quantile(pos, np.linspace(0.02, 1 - least, 40))
    return float(min(0.99, max(0.05, min(np.mean(unl >= c) / np.mean(pos >= c) for c in cuts))))


def fit(pos: np.ndarray, unl: np.ndarray, steps: int = 1200, rate: float = 0.05, decay: float = 1e-5) -> Model:
    both = np.vstack([pos, unl]).astype(np.float64)
    centre, scale = both.mean(0), both.std(0) + 0.02
    p, u = (np.clip((x - centre) / scale, -6, 6) for x in (pos, unl))
    prior = 0.5
    if len(p) > 20 and len(u) > 20:  # two first models, each scored on the half that it has not seen
        both_ways = []
        for a, b in ((0, 1), (1, 0)):
            w, _ = minimise(p[a::2], u[a::2], 0.5, steps // 2, rate, 1e-3)
            both_ways.append(estimate_prior(p[b::2] @ w, u[b::2] @ w))
        prior = sum(both_ways) / 2
    w, b = minimise(p, u, prior, steps, rate, decay)
    return Model(centre, scale, w, b, prior)


def train(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = 4000, most_unlabelled: int = 8000, seed: int = 3) -> Model | None:
    """Fits on a bounded sample: about ``most_positive`` of the ids in ``positives`` and
    ``most_unlabelled`` of all docs, each chosen by a hash of the id; None if either is empty.

    docs: unlabelled texts to learn from (marks are never read); positives: ids of trusted texts.
    The driver gets the feature rows of the sample only.
    """
    ids = positives.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    trusted = sampled(ids, "id", most_positive, seed)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    web = sampled(texts, "id", most_unlabelled, seed + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "x"])

    def gathered(df: DataFrame) -> np.ndarray:
        got = df.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, x binary").collect()
        return np.stack([np.frombuffer(r["x"], np.float32) for r in sorted(got, key=lambda r: (r["id"] or "", bytes(r["x"])))]) if got else np.zeros((0, N_FEATURES), np.float32)

    pos, unl = gathered(texts.join(F.broadcast(trusted), "id", "left_semi")), gathered(web)  # the sample's size is bounded
    return fit(pos, unl) if len(pos) and len(unl) else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` columns, ``score`` (0 to 1, higher: better) and ``predicted`` (1 if score >= threshold).

    A null text counts as empty; an empty text has the score of its (zero) features; without a
    model every score is 1. Repeated rows each get theirs; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    schema = chosen.drop("__text").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        m = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                last = batch.num_columns - 1
                s = _sigmoid(m.logits(features(batch.column(last)))) if m is not None else np.ones(batch.num_rows)
                columns = [batch.column(i) for i in range(last)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)
        tidy()

    return chosen.mapInArrow(run, schema)
