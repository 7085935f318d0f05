"""Hashed n-gram features whose learned weights are averaged over a text, and their training matrix.

A family gives each place of a text a slot of a table. A text's value in a slot is the share of its places there, so
a linear model over these values is the mean of slot weights over places: scoring is one look-up a place.

Families: chars2 and chars4 (n-grams of characters, letters' case kept), word, pair (two successive words; a pair of equal
words has one slot whatever the word).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hexweave.llm.tables import labelled_sample
from hexweave.llm.text import Texts, chunks, text_sums

BITS = 15
SLOTS = 1 << BITS
CHARS = {"chars2": 2, "chars4": 4}
FAMILIES = (*CHARS, "word", "pair")
_U = np.uint64
_TIMES = _U(0x9E3779B97F4A7C15)


def code_units(texts: Texts) -> np.ndarray:
    """A number for each character: its bytes of UTF-8, the first one lowest."""
    begin, _ = texts.characters
    size = np.diff(begin)
    code = texts.data[begin[:-1]].astype(_U)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        code[more] |= texts.data[begin[more] + j].astype(_U) << _U(8 * j)
    return code


def places(texts: Texts, family: str) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each place, index of each text's first place)."""
    if family in CHARS:
        n, code, before = CHARS[family], code_units(texts), texts.characters[1]
        h = code[: max(len(code) - n + 1, 0)].copy()
        for j in range(1, n):
            h = h * _TIMES + code[j : j + len(h)]
        h = ((h ^ (h >> _U(29))) * _TIMES) >> _U(64 - BITS)
        first = before[texts.offsets]
        sizes = np.maximum(np.diff(first) - n + 1, 0)
        inside = np.ones(len(h), bool)
        for j in range(1, n):
            at = first[1:] - j
            inside[at[(at >= first[:-1]) & (at < len(h))]] = False
        return h[inside].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
    h = texts.words.raw
    if family == "word":
        return (h >> _U(64 - BITS)).astype(np.int64), texts.words.first
    same = np.flatnonzero(h[1:] == h[:-1])
    pair = (h[:-1] * _U(0xD6E8FEB86659FD93) + h[1:] * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS)
    pair[same] = _U(0)
    inside = np.ones(len(pair), bool)
    last = texts.words.first[1:-1] - 1
    last = last[(last >= 0) & (last < len(pair))]
    inside[last] = False
    sizes = np.maximum(texts.words.counts - 1, 0)
    return pair[inside].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def linear(texts: Texts, weights: np.ndarray, bias: float) -> np.ndarray:
    """bias + the sum over families of the mean weight of the text's places."""
    out = np.full(texts.n, float(bias))
    for k, family in enumerate(FAMILIES):
        slots, first = places(texts, family)
        out += text_sums(weights[k * SLOTS : (k + 1) * SLOTS][slots], first) / np.maximum(np.diff(first), 1)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """([slots], [shares], labels) of a bounded sample; tasks count, the driver gets sparse rows only."""
    rows = labelled_sample(docs, labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, shares = [], []
            for _, texts in chunks(b.column(0)):
                made = [places(texts, f) for f in FAMILIES]
                for i in range(texts.n):
                    own_slots, own_shares = [], []
                    for k, (at, first) in enumerate(made):
                        u, n = np.unique(at[first[i] : first[i + 1]], return_counts=True)
                        own_slots.append(u + k * SLOTS)
                        own_shares.append(n / max(1, n.sum()))
                    slots.append(np.concatenate(own_slots))
                    shares.append(np.concatenate(own_shares))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64())), b.column(1)], names=["slots", "shares", "y"])

    got = rows.mapInArrow(run, "slots array<long>, shares array<double>, y int").toArrow()
    if not got.num_rows:
        return [], [], np.zeros(0, int)
    s, v = ([np.asarray(x.values) for x in got.column(c)] for c in ("slots", "shares"))
    y = np.asarray(got.column("y"))
    # By content, so that the model does not depend on how the rows were dealt to tasks.
    order = sorted(range(len(y)), key=lambda i: (len(s[i]), hashlib.sha1(s[i].tobytes() + v[i].tobytes()).digest(), y[i]))
    return [s[i] for i in order], [v[i] for i in order], y[order]


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic curve from raw scores to probabilities, by damped Newton steps with a weak prior."""
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    w = np.array([1.0, 0.0])
    target = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return max(float(w[0]), 1e-3), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
