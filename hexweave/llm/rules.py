"""Quality rules: exact counts, then a calibrated logistic regression over hashed n-grams.

Counts of a text's words (runs of what is not ASCII white space), symbols, repeated lines and repeated windows are
exact but for a 64-bit hash. A row fails on too few words or too many in repeated windows; the others are kept where
the model's probability of quality reaches a fixed threshold.

Null and empty texts have no words, so they fail. Without labelled rows of both kinds all probabilities are 1. Rows are
judged one by one, by the whole of their texts, very long ones too, so repeated rows and ids and null ids are judged like
others and equal texts equally. Columns other than those kept and text are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from hexweave.llm.features import FAMILIES, SLOTS, calibrate, linear, sigmoid, training_rows
from hexweave.llm.tables import map_texts, text_struct
from hexweave.llm.text import Texts, of_text, windows

#: Labelled rows of each kind that the model is fitted on at most.
PER_CLASS = 600
THRESHOLD = 0.4
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(h: np.ndarray) -> np.ndarray:
    """Marks hashes that occur twice or more."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def counts(texts: Texts) -> dict[str, np.ndarray]:
    words = texts.words
    chars = texts.per_text(words.inside & ((texts.data & 0xC0) != 0x80))
    lines = texts.lines()
    key = of_text(lines.raw, lines.doc)
    distinct = np.bincount(lines.doc[np.unique(key, return_index=True)[1]], minlength=texts.n)
    h, at = windows(words.raw, words.first, WINDOW)
    key = of_text(h, words.doc[at])
    hit = at[_repeated(key)]
    edge = np.zeros(len(words.starts) + WINDOW + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(np.cumsum(edge)[: len(words.starts)] > 0, out=covered[1:])
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": chars,
        "n_symbols": texts.per_text(_SYMBOL[texts.data]),
        "n_dup_lines": (lines.counts - distinct).astype(np.int64),
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
    }


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, texts: Texts) -> np.ndarray:
        return sigmoid(self.slope * linear(texts, self.weights, self.bias) + self.shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = 150) -> Model | None:
    """Full-batch Adam on four fifths of the sample, calibrated on the rest."""
    slots, shares, y = training_rows(docs, labels, "quality", per_class)
    if len(set(y.tolist())) < 2:
        return None
    n, width = len(y), len(FAMILIES) * SLOTS
    rest = np.arange(n) % 5 == 0
    sizes = np.array([len(s) for s in slots])
    row, col, val = np.repeat(np.arange(n), sizes), np.concatenate(slots), np.concatenate(shares)
    power = np.bincount(col, weights=val, minlength=width) / n
    scale = 1 / np.sqrt(power + 1e-5)
    val = val * scale[col]
    learn = ~rest
    share = np.where(y == 1, 0.5 / max(1, (y[learn] == 1).sum()), 0.5 / max(1, (y[learn] == 0).sum())) * learn
    w, b, m, v, mb, vb = np.zeros(width), 0.0, np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        raw = b + np.bincount(row, weights=val * w[col], minlength=n)
        e = (sigmoid(raw) - y) * share
        g = np.bincount(col, weights=val * e[row], minlength=width) + 1e-5 * w
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v) + 1e-8)
        b = b - rate * mb / (np.sqrt(vb) + 1e-8)
    raw = b + np.bincount(row, weights=val * w[col], minlength=n)
    slope, shift = calibrate(raw[rest], y[rest])
    return Model((w * scale).astype(np.float32), b, slope, shift)


VERDICT = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, p_quality double"


def _kernel(spark: SparkSession, model: Model | None, threshold: float) -> Callable[[Texts], dict]:
    shared = spark.sparkContext.broadcast(model)  # a table of SLOTS weights for each family

    def kernel(texts: Texts) -> dict:
        out = counts(texts)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
        p = shared.value.probability(texts) if shared.value else np.ones(texts.n)
        return out | {"base_failed": failed, "kept": ~failed & (p >= threshold), "p_quality": p}

    return kernel


def verdict(spark: SparkSession, model: Model | None, threshold: float = THRESHOLD) -> Column:
    """A struct of the counts, base_failed, kept and p_quality of a row's `text`."""
    return text_struct(VERDICT, _kernel(spark, model, threshold))


def judge(docs: DataFrame, keep: list[str], model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, the counts, base_failed, kept and p_quality of each row."""
    return map_texts(docs, keep, VERDICT, _kernel(docs.sparkSession, model, threshold))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, ["doc_id"], fit(docs, labels))
