"""Quality by supervised subword embeddings.

Each slot of the word and character n-gram tables has a learned vector. A text is the mean of its places' vectors in
each family, under a softmax over both labels; numpy stochastic gradient descent trains all of it. The output layer
being linear, a slot's vector counts as one number at scoring time: its product with the difference of both outputs.

Null and empty texts have zero vectors and get the score of the outputs' biases. Without labelled rows of both kinds
all scores are 0.5. Rows are scored one by one, by the whole of their texts, very long ones too, so repeated rows and ids
and null ids are scored like others and equal texts equally. Columns other than those kept and text are not looked at.
An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.llm.features import FAMILIES, SLOTS, linear, sigmoid, training_rows
from hexweave.llm.tables import fold, map_texts
from hexweave.llm.text import Texts

#: Labelled rows of each kind that the model is fitted on at most.
PER_CLASS = 600
DIM = 16
THRESHOLD = 0.3


@dataclass
class Model:
    vectors: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray

    def slot_scores(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.outputs[1] - self.outputs[0])).astype(np.float32), float(self.biases[1] - self.biases[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = 8, rate: float = 0.5) -> Model | None:
    slots, shares, y = training_rows(docs, labels, "quality", per_class)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(7)
    width = len(FAMILIES) * SLOTS
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (width, DIM))
    outputs, biases = rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    power = np.bincount(np.concatenate(slots), weights=np.concatenate(shares), minlength=width) / len(y)
    scale = 1 / np.sqrt(power + 1e-4)  # as if each slot had been seen equally often
    balance = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(y)):
            at, x = slots[i], shares[i] * scale[slots[i]]
            hidden = x @ vectors[at]
            z = outputs @ hidden + biases
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= balance[y[i]]
            back = p @ outputs
            outputs -= 0.1 * step * np.outer(p, hidden)
            biases -= 0.1 * step * p
            vectors[at] -= step * np.outer(x, back) / (1 + x @ x)
    return Model(vectors * scale[:, None], outputs, biases)


def score(docs: DataFrame, keep: list[str], model: Model | None) -> DataFrame:
    """The kept columns and p_good of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.slot_scores() if model else None)  # a number a slot

    def kernel(texts: Texts) -> dict:
        return {"p_good": sigmoid(linear(texts, *shared.value)) if shared.value else np.full(texts.n, 0.5)}

    return map_texts(docs, keep, "p_good double", kernel)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    rows = score(docs, ["doc_id"], fit(docs, labels))
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("p_good").alias("score"), (F.col("p_good") >= threshold).cast("int").alias("predicted"))
