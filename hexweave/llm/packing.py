"""Packing documents' tokens into sequences of a fixed length, by a configuration linear program.

Each text is encoded, ended with an id, and cut into pieces only where it is longer than a sequence. What the plan
needs of the corpus is the histogram of piece lengths, at most `size` counts. The linear program over patterns (which
lengths share a sequence) is solved by multiplicative weights: lengths have weights, a knapsack by dynamic
programming prices a pattern around the length of most weight, and covered lengths lose weight. Amounts of patterns are
rounded down to whole sequences as they are found, and the program goes on with the pieces left; the last few
sequences' worth goes by best fit. Pieces then take their places by their rank among pieces of their length.

Null texts count as empty: one piece that holds the end id alone. Rows are packed one by one, so repeated rows and null
ids are packed like others; columns other than doc_id and text are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexweave.llm.bpe import tokenizer
from hexweave.llm.tables import cut_texts
from hexweave.llm.text import Texts, chunks
from hexweave.storage import cut

SIZE = 4096
END_ID = 1
#: Classes among which a pattern is priced; how fast weights shrink; what weights count for beside tokens.
CANDIDATES, RATE, TILT = 48, 0.1, 1e-4
#: Sequences whose pieces are left to best fit at the end.
REMAINDER = 16
#: Slots of a worker's table of words, a word each.
SLOTS = 1 << 20
#: Ids after which that table is begun anew, and bytes of the longest word in it.
POOL, WORD_BYTES = 1 << 22, 64
#: Words in one call of the tokenizer.
JOINED = 256
_U = np.uint64
# Bytes of ASCII letters and of what is U+00C0 to U+023F in UTF-8, all letters but for the characters of _NO_LETTER:
# signs, and a capital whose small form has a mark of its own.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
_NO_LETTER = [tuple(c.encode()) for c in "\u00d7\u00f7\u0130"]
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


class WordIds:
    """Ids of whole texts of a tokenizer that drops white space, unit by unit.

    A unit is a word between ASCII white space, or its letters and its punctuation, where it is Latin letters and then
    ASCII punctuation: no token of such a tokenizer reaches from letters into punctuation. A unit's ids are looked up by its
    64-bit hash and its length in a table of bounded size, in which a new unit takes the place of the one in its slot.
    New units of letters go through the tokenizer JOINED at a time with spaces between; the token that ends a word tells
    where the next begins. Where there are not as many such tokens as words, and for other units, each is encoded alone.
    """

    def __init__(self, path: str):
        self.path = path
        suffix = getattr(tokenizer(path).model, "end_of_word_suffix", None)
        vocab = tokenizer(path).get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.bytes = np.zeros(SLOTS, _U), np.zeros(SLOTS, np.int32)
        self.starts, self.lengths = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, "<u4"), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where the pool has these ids now."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(self.used, "<u4")])
        self.pool[at : self.used] = ids
        return at

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in the pool of each unit's ids."""
        found = [np.array(e.ids, "<u4") for e in tokenizer(self.path).encode_batch_fast(units, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        at = self._keep(np.concatenate(found)) if found else 0
        return at + np.cumsum(lengths) - lengths, lengths

    def _encode_letters(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [units[lo : lo + JOINED] for lo in range(0, len(units), JOINED)]
        starts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, e in zip(groups, tokenizer(self.path).encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                n = np.diff(ends, prepend=0)
                at = self._keep(ids) + ends - n
            else:
                at, n = self._encode(own)
            starts.append(at)
            lengths.append(n)
        return np.concatenate(starts), np.concatenate(lengths)

    def units(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, whether it is Latin letters) of each unit."""
        starts, ends = texts.words.starts, texts.words.ends
        at = np.arange(len(texts.data))
        tail = np.maximum.accumulate(np.where(_PUNCTUATION[texts.data], -1, at))[ends - 1] + 1 if len(ends) else ends
        tail = np.maximum(tail, starts)  # where the punctuation that ends the word begins
        others = np.zeros(len(texts.data) + 1, np.int64)
        other = ~_LETTER[texts.data]
        for lead, byte in _NO_LETTER:
            other[1:] |= (texts.data[1:] == byte) & (texts.data[:-1] == lead)
        np.cumsum(other, out=others[1:])
        letters = (tail > starts) & (others[tail] == others[starts])
        two = letters & (tail < ends)
        place = np.arange(len(starts)) + np.cumsum(two) - two
        out = np.zeros((3, len(starts) + int(two.sum())), np.int64)
        out[:, place] = starts, np.where(two, tail, ends), letters
        out[:, place[two] + 1] = tail[two], ends[two], np.zeros(int(two.sum()))
        return out[0], out[1], out[2].astype(bool)

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, index of each text's first and the end of the last)."""
        if self.used > POOL // 2:
            self.forget()
        begin, end, letters = self.units(texts)
        size = end - begin
        h = texts.span_hash(begin, end, False)
        slot = (h >> _U(40)).astype(np.int64) & (SLOTS - 1)
        starts, lengths = self.starts[slot].astype(np.int64), self.lengths[slot].astype(np.int64)
        missing = np.flatnonzero((self.keys[slot] != h) | (self.bytes[slot] != size))
        _, first, of = np.unique(h[missing], return_index=True, return_inverse=True)
        new = missing[first]
        new_starts, new_lengths = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        raw = texts.data.tobytes()
        for encode, own in ((self._encode_letters, np.flatnonzero(letters[new])), (self._encode, np.flatnonzero(~letters[new]))):
            words = [raw[lo:hi].decode() for lo, hi in zip(begin[new[own]].tolist(), end[new[own]].tolist())]
            new_starts[own], new_lengths[own] = encode(words)
        starts[missing], lengths[missing] = new_starts[of], new_lengths[of]
        known = np.flatnonzero(size[new] <= WORD_BYTES)
        at = slot[new[known]]
        self.keys[at], self.bytes[at], self.starts[at], self.lengths[at] = h[new[known]], size[new[known]], new_starts[known], new_lengths[known]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, texts.offsets)]


_encoders: dict[str, WordIds] = {}


def pieces_of(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part, local): `local` ranks a task's pieces of one length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        part, ranks = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for whole in batches:
            for lo, texts in chunks(whole.column(1)):
                ids, first = _encoders[path].of(texts)
                ids = np.insert(ids, first[1:], end_id)
                raw, rows = ids.tobytes(), []
                bounds = (first + np.arange(texts.n + 1)).tolist()
                for doc_id, begin, end in zip(whole.column(0).slice(lo, texts.n).to_pylist(), bounds, bounds[1:]):
                    for k, at in enumerate(range(begin, end, size)):
                        n = min(size, end - at)
                        rows.append((doc_id, k, at - begin, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), part, int(ranks[n]), *[ids[at : at + n]] * with_ids))
                        ranks[n] += 1
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(cols[i], kinds[i]) for i in range(len(names))], names=names)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def price(lengths: np.ndarray, weights: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """How often each class stands in the pattern of most weight: a bounded knapsack by dynamic programming.

    A class's pieces, as many as fit, are items of 1, 2, 4, ... pieces; an item is taken or not, for all capacities at once.
    """
    items = []
    for k, most in enumerate(np.minimum(counts, size // lengths).tolist()):
        n = 1
        while most > 0:
            items.append((k, min(n, most)))
            most -= n
            n *= 2
    best, taken = np.zeros(size + 1), np.zeros((len(items), size + 1), bool)
    for i, (k, n) in enumerate(items):
        room = n * int(lengths[k])
        gain = best[: size + 1 - room] + n * weights[k]
        taken[i, room:] = gain > best[room:]
        best[room:] = np.maximum(best[room:], gain)
    times, room = np.zeros(len(lengths), np.int64), size
    for i in range(len(items) - 1, -1, -1):
        if taken[i, room]:
            k, n = items[i]
            times[k] += n
            room -= n * int(lengths[k])
    return times


def program(left: dict[int, int], size: int, remainder: int = REMAINDER) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """([(lengths in a sequence, how many such sequences)], pieces left): patterns for all but about `remainder` sequences.

    Every length is a class of its own. A class's weight begins as its length and shrinks as its pieces are covered, so the
    class of most weight is one that is long and has waited. It gets a pattern: the knapsack fills the rest of the sequence
    from CANDIDATES classes, half of them those of most weight, half spread over the lengths that fit beside it. A class
    counts for its tokens there and, far less, for its weight, as tokens are the program's dual prices where sequences can
    be filled. The pattern is used as often as its scarcest class allows, rounded down; each round uses a class up or
    nearly, so rounds follow the number of lengths, whatever the number of pieces.
    """
    lengths = np.array(sorted(k for k, n in left.items() if n > 0), np.int64)
    stock = np.array([left[int(k)] for k in lengths], np.int64)
    whole, weights, plan = stock.copy(), lengths / size, []
    tokens = int((lengths * stock).sum())
    while tokens > remainder * size:
        have = np.flatnonzero(stock)
        top = have[np.argsort(-weights[have], kind="stable")[: CANDIDATES // 2]]
        first, room = top[0], size - int(lengths[top[0]])
        beside = have[lengths[have] <= room]
        spread = beside[np.linspace(0, len(beside) - 1, min(len(beside), CANDIDATES // 2)).astype(int)]
        own = np.union1d(top[lengths[top] <= room], spread).astype(np.int64)
        times = np.zeros(len(lengths), np.int64)
        if len(own):
            times[own] = price(lengths[own], lengths[own] / size * (1 + TILT * weights[own]), stock[own] - (own == first), room)
        times[first] += 1
        on = np.flatnonzero(times)
        step = int((stock[on] // times[on]).min())
        stock -= step * times
        weights[on] *= 1 - RATE * step * times[on] / whole[on]
        tokens -= step * int((times * lengths).sum())
        plan.append((tuple(int(x) for x in np.repeat(lengths[on], times[on])[::-1]), step))
    return plan, {int(k): int(n) for k, n in zip(lengths, stock) if n}


def solve(histogram: dict[int, int], size: int = SIZE, remainder: int = REMAINDER) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, how many such sequences)], each piece once.

    Sequences that one piece fills are set aside. The program deals out all but some `remainder` sequences' worth of the other
    pieces; best fit deals those into what room the patterns have and into sequences of their own.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    full = [((size,), left.pop(size))] if left.get(size) else []
    plan, rest = program(left, size, remainder)
    return full + best_fit(rest, size, plan)


def best_fit(left: dict[int, int], size: int, started: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest open sequences that have room; equal open sequences move together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(size + 1, dtype=np.int64)
    done: list[tuple[tuple[int, ...], int]] = []

    def put(free: int, pattern: tuple[int, ...], n: int) -> None:
        if free == 0:
            done.append((pattern, n))
        else:
            open_.setdefault(free, []).append((pattern, n))
            room[free] += n

    for pattern, n in started:
        put(size - sum(pattern), pattern, n)
    for length in sorted((k for k, v in left.items() if v > 0), reverse=True):
        n = left[length]
        while n:
            at = np.flatnonzero(room[length:])
            if not len(at):
                per = size // length
                if n >= per:
                    put(size - per * length, (length,) * per, n // per)
                if n % per:
                    put(size - n % per * length, (length,) * (n % per), 1)
                break
            free = length + int(at[0])
            pattern, have = open_[free].pop()
            each = min(free // length, max(1, n // have))
            take = min(have, n // each)
            room[free] -= have
            if take < have:
                put(free, pattern, have - take)
            put(free - each * length, pattern + (length,) * each, take)
            n -= take * each
    return done + [x for rows in open_.values() for x in rows]


class Places:
    """Where the r-th piece of a length goes: slots of a length are runs over sequences of one pattern."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for pattern, n in plan:
            at = 0
            for length in pattern:
                slots.setdefault(length, []).append((n, base, at))
                at += length
            base += n
        self.runs = {k: (np.concatenate([[0], np.cumsum([x[0] for x in v])]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for k, v in slots.items()}
        self.sequences = base

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            ends, bases, ats = self.runs[int(n)]
            k = np.searchsorted(ends, rank[own], side="right") - 1
            sequence[own] = bases[k] + rank[own] - ends[k]
            offset[own] = ats[k]
        return sequence, offset


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every row."""
    rows = cut_texts(pieces_of(docs, path, size, end_id, with_ids))
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = cut(by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    places = rows.sparkSession.sparkContext.broadcast(Places(solve(histogram, size)))  # patterns of at most `size` lengths
    # Ranks are tasks times lengths in number, which is not to be broadcast.
    ranked = rows.join(ranks.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(sequence), pa.array(offset)], names=[*cols, "sequence_id", "offset"])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return ranked.select(*cols, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
