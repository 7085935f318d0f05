"""Toxicity by a factorization machine over hashed terms.

Terms are lower-case words and their beginnings of PREFIXES bytes, hashed to 2 ** BITS slots; a text has a term or has it
not. Each slot has a weight and a vector, and two terms of a text add the product of their vectors, so that an insult
beside a mention of a group weighs more than both alone. All slots learn: weights by gradient steps that leave one at 0
until the rows have moved it by more than SPARSITY, and a slot's vector takes part while its weight is not 0.

Null and empty texts have no terms and get the score of the bias. Without labelled rows of both kinds all scores are 0.
Rows are scored one by one, by what terms they have, so repeated rows and ids and null ids are scored like others, equal
texts equally, and a very long text by all its terms. Columns other than doc_id and text are not looked at, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.llm.features import calibrate, sigmoid
from hexweave.llm.tables import fold, labelled_sample, map_texts
from hexweave.llm.text import Texts, chunks

#: Labelled rows of each kind that the model is fitted on at most.
PER_CLASS = 1500
BITS = 20
PREFIXES = (5,)
RANK = 8
#: How far the rows have to move a weight from 0; of 5, 10, 20 and 30 the best by inner_accuracy on the 0.1 tables.
SPARSITY = 20.0
_U = np.uint64


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of each word and each beginning of a longer word; repeats stay."""
    t = texts.terms
    slots, docs = [t.lower], [t.doc]
    for n in PREFIXES:
        long = np.flatnonzero(t.ends - t.starts > n)
        slots.append(texts.span_hash(t.starts[long], t.starts[long] + n, True) * _U(2 * n + 1))
        docs.append(t.doc[long])
    return (np.concatenate(slots) >> _U(64 - BITS)).astype(np.int64), np.concatenate(docs)


def distinct(slots: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(docs * width + slots)
    return key % width, key // width


@dataclass
class Model:
    number: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    slope: float
    shift: float

    def probability(self, texts: Texts) -> np.ndarray:
        slots, docs = terms(texts)
        own = self.number[slots]
        hit = own >= 0
        own, docs = distinct(own[hit].astype(np.int64), docs[hit], len(self.weights))
        return sigmoid(self.slope * self.raw(own, docs, texts.n) + self.shift)

    def raw(self, own: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(docs, weights=self.weights[own], minlength=n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[own, f]
            out += 0.5 * (np.bincount(docs, weights=v, minlength=n) ** 2 - np.bincount(docs, weights=v * v, minlength=n))
        return out


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[np.ndarray], np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, texts in chunks(b.column(0)):
                slots, of = distinct(*terms(texts), 1 << BITS)
                rows += np.split(slots.astype(np.int32), np.searchsorted(of, np.arange(1, texts.n)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), b.column(1)], names=["slots", "y"])

    got = labelled_sample(docs, labels, "toxic", per_class).mapInArrow(run, "slots array<int>, y int").toArrow()
    rows, y = [np.asarray(x.values) for x in got.column("slots")], np.asarray(got.column("y"))
    order = sorted(range(len(y)), key=lambda i: (len(rows[i]), rows[i].tobytes(), y[i]))  # by content
    return [rows[i] for i in order], y[order] if len(y) else y


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sparsity: float = SPARSITY) -> Model | None:
    """From a bounded sample of rows outside the held-out fold: tasks find the terms, the driver trains."""
    rows, y = training_rows(docs, labels, per_class)
    return learn_model(rows, y, sparsity) if len(set(y.tolist())) == 2 else None


def inner_accuracy(docs: DataFrame, labels: DataFrame, sparsity: float, per_class: int = PER_CLASS) -> float:
    """Balanced accuracy over every third row of the training sample of a model of the others: for choosing SPARSITY."""
    rows, y = training_rows(docs, labels, per_class)
    apart = np.arange(len(y)) % 3 == 1
    model = learn_model([r for r, a in zip(rows, apart) if not a], y[~apart], sparsity)
    own = [np.unique(model.number[r][model.number[r] >= 0]).astype(np.int64) for r, a in zip(rows, apart) if a]
    raw = model.raw(np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own]), len(own))
    right = (sigmoid(model.slope * raw + model.shift) >= 0.5) == y[apart]
    return float(np.mean([right[y[apart] == k].mean() for k in (0, 1)]))


def learn_model(rows: list[np.ndarray], y: np.ndarray, sparsity: float = SPARSITY, epochs: int = 12, rate: float = 0.1, vector_rate: float = 0.01) -> Model:
    """Stochastic gradient descent on four fifths of the rows, follow-the-regularised-leader for the weights and AdaGrad
    for the vectors; the rest calibrates. Scores then go half of the way, in log odds, from the sample's share of label 1
    to even odds, as few rows have it."""
    slots, flat = np.unique(np.concatenate(rows), return_inverse=True)  # the rows' own, in fewer numbers
    own = [np.unique(x) for x in np.split(flat, np.cumsum([len(r) for r in rows])[:-1])]
    rng = np.random.default_rng(11)
    bias, w, v = 0.0, np.zeros(len(slots)), rng.normal(0, 0.05, (len(slots), RANK))
    gb, z, gw, gv = 1.0, np.zeros(len(slots)), np.zeros(len(slots)), np.ones_like(v)
    learn = np.flatnonzero(np.arange(len(y)) % 5 != 0)
    balance = len(learn) / (2 * np.maximum(1, np.bincount(y[learn], minlength=2)))
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at = own[i]
            on = at[w[at] != 0]
            total = v[on].sum(0)
            raw = bias + w[on].sum() + 0.5 * float((total**2).sum() - (v[on] ** 2).sum())
            e = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]) * balance[y[i]]
            z[at] += e - (np.sqrt(gw[at] + e * e) - np.sqrt(gw[at])) / rate * w[at]
            gw[at] += e * e
            w[at] = -np.sign(z[at]) * np.maximum(np.abs(z[at]) - sparsity, 0) / ((1 + np.sqrt(gw[at])) / rate + 1)
            dv = e * (total - v[on]) + 1e-3 * v[on]
            gv[on] += dv * dv
            v[on] -= vector_rate * dv / np.sqrt(gv[on])
            gb += e * e
            bias -= rate * e / np.sqrt(gb)
    live = np.flatnonzero(w)
    number = np.full(1 << BITS, -1, np.int32)
    number[slots[live]] = np.arange(len(live))
    own = [np.unique(number[r][number[r] >= 0]).astype(np.int64) for r in rows]
    w, v = (w[live], v[live]) if len(live) else (np.zeros(1), np.zeros((1, RANK)))
    model = Model(number, bias, w, v, 1.0, 0.0)
    rest = [i for i in range(len(y)) if i % 5 == 0]
    docs_of = np.repeat(np.arange(len(rest)), [len(own[i]) for i in rest])
    raw = model.raw(np.concatenate([own[i] for i in rest]), docs_of, len(rest))
    model.slope, model.shift = calibrate(raw, y[rest])
    model.shift += 0.5 * float(np.log((y == 0).sum() / (y == 1).sum()))
    return model


def score(docs: DataFrame, keep: list[str], model: Model | None) -> DataFrame:
    """The kept columns and p_toxic of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most 2 ** BITS slots

    def kernel(texts: Texts) -> dict:
        return {"p_toxic": shared.value.probability(texts) if shared.value else np.zeros(texts.n)}

    return map_texts(docs, keep, "p_toxic double", kernel)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    rows = score(docs, ["doc_id"], fit(docs, labels))
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= threshold).cast("int").alias("predicted"))
