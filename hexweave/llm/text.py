"""Words, lines and n-grams of many texts at once, as numpy arrays over an Arrow string column's bytes.

A column is walked in chunks of about CHUNK bytes (a longer text is a chunk of its own and stays whole), which
bounds a task's memory. Null texts count as empty. Hashes are 64-bit polynomials of the bytes, mixed afterwards.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_TERM = np.ones(256, bool)
_NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def of_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts. Numbers of texts are spread first: as they are, they meet hashes of single bytes."""
    return mix(h + mix(text.astype(_U) * _U(_BASE) + _U(0xD1B54A32D192ED03)))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, kept for the worker's life up to a chunk's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


class Texts:
    """Some whole texts: their bytes, and where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """A hash of each byte span, by differences of one running sum."""
        sums = self._sums_lower if lower else self._sums_raw
        h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(self.data) + 1)[starts]
        return mix(h + (ends - starts).astype(_U))

    def _sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, len(data)), out=out[1:])
        return out

    @cached_property
    def lowered(self) -> np.ndarray:
        """A-Z in lower case, all else as it is."""
        return _LOWER[self.data]

    @cached_property
    def _sums_lower(self) -> np.ndarray:
        return self._sums(self.lowered)

    @cached_property
    def _sums_raw(self) -> np.ndarray:
        return self._sums(self.data)

    @cached_property
    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """(where each character begins, and the end; how many begin before each byte, and before the end)."""
        first = (self.data & 0xC0) != 0x80
        before = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(first, out=before[1:])
        return np.append(np.flatnonzero(first), len(self.data)), before

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def runs(self, separator: np.ndarray) -> "Runs":
        """Maximal runs of bytes that are no separators; none goes across texts."""
        inside = ~separator[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        begin, end = self.offsets[:-1], self.offsets[1:]
        full = end > begin
        before[begin[full]] = False
        after[end[full] - 1] = False
        return Runs(self, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1, inside)

    @cached_property
    def words(self) -> "Runs":
        """Runs of what is not ASCII white space."""
        return self.runs(_SPACE)

    @cached_property
    def terms(self) -> "Runs":
        """Runs of ASCII letters and digits and of all that is not ASCII."""
        return self.runs(_NOT_TERM)

    def lines(self) -> "Runs":
        """Lines with a word in them, as \\n splits."""
        breaks = np.zeros(256, bool)
        breaks[10] = True
        out = self.runs(breaks)
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(self.words.inside, out=sums[1:])
        has = sums[out.ends] > sums[out.starts]
        return Runs(self, out.starts[has], out.ends[has], out.inside)


class Runs:
    """Spans of some texts, which it refers to weakly: a cycle would keep a chunk's arrays until garbage is collected."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray):
        self.texts, self.starts, self.ends, self.inside = weakref.proxy(texts), starts, ends, inside

    @cached_property
    def first(self) -> np.ndarray:
        """Index of each text's first run, and the end of the last."""
        return np.searchsorted(self.starts, self.texts.offsets)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)

    @cached_property
    def lower(self) -> np.ndarray:
        return self.texts.span_hash(self.starts, self.ends, True)

    @cached_property
    def raw(self) -> np.ndarray:
        return self.texts.span_hash(self.starts, self.ends, False)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of each window of `size` successive words that stays in its text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = hashes[:n] * _U(_BASE)
    for j in range(1, size):
        h = h * _U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    inside = np.ones(len(hashes), bool)
    for j in range(1, size):
        at = first[1:] - j
        at = at[at >= first[:-1]]
        inside[at] = False
    inside = inside[:n]
    return mix(h[inside]), np.flatnonzero(inside)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, Texts]]:
    """(number of texts before, texts) over a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0:
        return
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, Texts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of float values of each text, given each text's first index; 0 where a text has none."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
