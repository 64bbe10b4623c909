"""Quality by Bradley-Terry ranking.

A document is a vector of form: lengths, repetition, marks, line shapes. Preference pairs (a better and a worse
labelled document) are fitted by logistic loss on the differences of their vectors, which gives each document
one score on a line. The threshold is a quantile of the fitting sample's scores, the one that tells its labels
apart best; scores map to 0..1 so that the threshold is ``CUT``.

Defined results: a null or empty text is a vector of zeros with its own flag; copies and repeated rows get equal
scores; without labels of both kinds every document scores CUT; an empty table gives an empty result; very long
texts are read whole; extra columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import fold, sample

CUT = 0.7
#: Better documents that each worse one is paired with.
PARTNERS = 12
_MARKS = bytes(b if b in b"#$%&*|@^~<>{}[]=+_\\/" else 32 for b in range(256))
_ENDS = str.maketrans({c: None for c in ".,;:!?"})


def features(text: str | None) -> list[float]:
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * 15 + [1.0]
    counts = Counter(words)
    chars = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode()
    marks = len(b"".join(data.translate(_MARKS).split()))
    repeats = sum(map(str.__eq__, words, words[1:]))
    ended = sum(text.count(c) for c in ".!?")
    letters = sum(map(len, words))
    common = counts.most_common(1)[0][1]
    return [
        min(math.log1p(n), 8.0), len(counts) / n ** 0.9, repeats / n, common / n, min(marks / n, 3.0), min(words.count("|") / n, 1.0),
        min(ended / n, 1.0), math.log1p(n / (ended + 1)), min(letters / n, 30.0),
        1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)),
        sum(map(str.isdigit, words)) / n, min(text.count(",") / n, 1.0), sum(w[0].isupper() for w in words) / n,
        (chars - letters) / chars, 0.0,
    ]


def expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, both clipped."""
    z = np.clip((x - mean) / spread, -6, 6)
    return np.hstack([z, np.minimum(z * z, 16)])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.mean, self.spread) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = (self.raw(np.array([features(t) for t in texts]).reshape(-1, 16)) - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(z + math.log(CUT / (1 - CUT)), -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Newton steps on the logistic loss of the pairs' feature differences."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(16), np.ones(16))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not good.size or not bad.size:
        return Model(mean, spread, np.zeros(32), 0.0, 1.0)
    z = expand(x, mean, spread)
    partner = np.random.default_rng(5).integers(0, good.size, (bad.size, PARTNERS))
    w = bradley_terry(z[good[partner.ravel()]], z[np.repeat(bad, PARTNERS)])
    s = z @ w
    order = np.sort(s)
    # Threshold by score quantile: the one with most labels on the right side; of equals, the middle.
    places = np.unique(np.linspace(0, len(s) - 1, 400).astype(int))
    right = np.array([((s >= order[p]) == (y == 1)).mean() for p in places])
    best = places[right >= right.max() - 1e-12]
    at = int(best[len(best) // 2])
    threshold = float((order[at] + order[max(at - 1, 0)]) / 2)
    return Model(mean, spread, w, threshold, max(float(s.std()) / 2, 1e-6))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2)

    def describe(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    got = rows.select("y", F.arrow_udf(describe, "array<double>").asNondeterministic()("text").alias("x")).collect()  # SAMPLE short rows at most
    return fit(np.array([r.x for r in got]).reshape(-1, 16), np.array([r.y for r in got]))


def score(text: Column, model: Model) -> Column:
    return F.arrow_udf(lambda texts: pa.array(model.score(texts.to_pylist()), pa.float64()), "double").asNondeterministic()(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted")
    )
