"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings (the first four to six
characters, so that inflected forms of one stem share a feature). Besides the log-loss of the
labels it pays for score changes under swaps: in each labelled text that mentions a group, the
identity terms of every sentence are exchanged for others of their list, and the squared
difference of the two texts' logits enters the objective. A neutral mention of a group then
cannot by itself carry a score.

Learning uses at most about ``bound`` labelled texts (half of them toxic at most, the rest
weighted to stand for all), chosen by a hash of the id; that table is small enough to be
broadcast. Scores are computed for every row from its whole text.

Defined results: null and empty texts have no feature and get the score of the intercept;
without labels, or with labels of one class only, every score is that class (0 without any).
Several labels of one document count as toxic if any does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import texts
from seqcohort.session import settle

# Identity terms that are exchanged for one another, one list a line.
IDENTITY = (
    "women men girls boys mothers fathers",
    "woman man girl boy mother father",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab african european american mexican indian chinese",
    "gay lesbian bisexual transgender straight heterosexual",
    "immigrants refugees foreigners locals citizens",
    "old young elderly teenage",
    "deaf blind disabled",
)
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
STEMS = (4, 5, 6)
MEMORY = 300_000


def features_of(word: str) -> list[str]:
    """A word and its beginnings; the latter end in ``*``."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def exchanges() -> dict[str, list[str]]:
    return {w: [v for v in line.split() if v != w] for line in IDENTITY for w in line.split()}


def counterfactual(words: list[str], swaps: dict[str, list[str]], turn: int) -> list[str]:
    """A sentence with each identity term exchanged for the next of its list; ``turn`` moves on."""
    return [swaps[w][(turn + i) % len(swaps[w])] if w in swaps else w for i, w in enumerate(words)]


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    intercept: float
    memory: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def columns(self, word: str) -> tuple[int, ...]:
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            got = tuple(self.index[f] for f in features_of(word) if f in self.index)
            if len(word) <= 64:
                self.memory[word] = got
        return got

    def row(self, text: str | None) -> list[int]:
        """Columns of the features present in a text."""
        found: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            found.update(self.columns(word))
        return sorted(found)

    def score(self, text: str | None) -> float:
        z = self.intercept + float(sum(self.weights[c] for c in self.row(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def sample_labels(labels: DataFrame, train: Column, bound: int) -> DataFrame:
    """``id, toxic, weight``: at most about ``bound`` labelled ids, both classes if there are."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("id")
    ).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).filter(train)
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic = min(n.get(1, 0), bound // 2)
    take = {1: toxic, 0: min(n.get(0, 0), bound - toxic)}
    share = {c: take[c] / n[c] if n.get(c) else 1.0 for c in (0, 1)}
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.col("id")), F.lit(1_000_003)) / 1_000_003.0
    own = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    return known.filter(draw < own).withColumn("weight", 1 / own)


def feature_rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for toxic, weight, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            found = {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([weight * toxic] * len(found), pa.float64()),
                 pa.array([weight * (1 - toxic)] * len(found), pa.float64())], ["feature", "pos", "neg"],
            )


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, diff: np.ndarray, ridge: float, pair: float,
           rounds: int = 25) -> np.ndarray:
    """Weights that minimise weighted log-loss + pair * |diff w|^2 / 2 + ridge * |w|^2 / 2; the
    last column of ``x`` is constant and not shrunk."""
    w = np.zeros(x.shape[1])
    fixed = pair * (diff.T @ diff).astype(np.float64) + ridge * np.diag(np.r_[np.ones(x.shape[1] - 1), 1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w.astype(np.float32)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + w @ fixed @ w / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -40, 40)))
        grad = x.T @ (weight * (p - y)) + fixed @ w
        curve = np.maximum(weight * p * (1 - p), 1e-9).astype(np.float32)
        step = np.linalg.solve((x.T @ (x * curve[:, None])).astype(np.float64) + fixed, grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        after = loss(w)
        if now - after < 1e-7 * max(1.0, abs(now)):
            break
        now = after
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        bound: int = 16_000, n_features: int = 400, pair: float = 10.0, ridge: float = 1.0) -> Model:
    """The model of labelled documents whose ``id`` meets ``train``. The driver sees at most
    ``n_features`` features and, for at most about ``bound`` texts, which of them are present."""
    chosen = settle(sample_labels(labels, train, bound))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # One id may stand on many rows: equal ones count once, others are drawn by their texts down to the bound.
    met = source.join(F.broadcast(chosen), "id").groupBy("id", "toxic", "weight", F.sha2("text", 256)).agg(F.first("text").alias("text"))
    sample = settle(met)
    many = sample.count()
    if many > 1.1 * bound:
        draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0
        sample = sample.filter(draw < bound / many)
    sample = sample.select("toxic", "weight", "text")
    sizes = {r.toxic: r.w for r in sample.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    if len(sizes) < 2:
        return Model({}, np.zeros(0), 40.0 if 1 in sizes else -40.0)
    pos, neg = sizes[1], sizes[0]
    rate1, rate0 = (F.col("pos") + 0.5) / (pos + 1), (F.col("neg") + 0.5) / (neg + 1)
    merit = F.abs(F.log(rate1 / rate0)) * F.sqrt(F.col("pos") + F.col("neg") * pos / neg)
    ranked = sample.mapInArrow(feature_rows, "feature string, pos double, neg double").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    ).orderBy(F.desc(F.round(merit, 9)), "feature").limit(n_features)
    swaps = exchanges()
    names = list(dict.fromkeys([r.feature for r in ranked.collect()] + sorted(swaps)))
    model = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), 0.0)

    def present(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            own, other = [], []
            for text in texts(batch.column(2)):
                own.append(model.row(text))
                sentences = [WORD.findall(s) for s in SENTENCE.split((text or "").lower())]
                if any(w in swaps for s in sentences for w in s):
                    changed = [counterfactual(s, swaps, i) for i, s in enumerate(sentences)]
                    other.append(model.row(" ".join(w for s in changed for w in s)))
                else:
                    other.append(None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own, kind), pa.array(other, kind)], ["toxic", "weight", "own", "other"]
            )

    rows = sample.mapInArrow(present, "toxic int, weight double, own array<int>, other array<int>").collect()
    x, diff = np.zeros((len(rows), len(names) + 1), np.float32), []
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r.own] = 1
        if r.other is not None:
            swapped = np.zeros(len(names) + 1, np.float32)
            swapped[r.other + [len(names)]] = 1
            diff.append(x[i] - swapped)
    diff = np.stack(diff) if diff else np.zeros((0, x.shape[1]), np.float32)
    w = newton(x, np.array([r.toxic for r in rows], np.float32), np.array([r.weight for r in rows], np.float32), diff, ridge, pair)
    return Model(model.index, w[:-1], float(w[-1]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [model.score(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")
