"""Numbers of tokens of whole texts, of huge ones by overlapping chunks that meet again at stable boundaries.

For byte-level BPE files whose words come from a left-to-right scan without look-behind. Where such a scan begins a word, what
follows depends on the rest of the text alone. A text of up to `huge` bytes is counted by its units, runs of white space
with the text behind them: these encode alone, and a worker remembers their counts.

A longer text goes as chunks of `stride` + `overlap` characters, one each `stride`, which any task may encode. The library
gives each token's offset and word. A word that begins in a chunk's last characters may be another one in the whole
text, as may a special token that the chunk's end cuts off, so these places do not count: see `margin`. The first chunk
begins where the text does, so its words are the text's. Where a chunk's words and the next one's have a beginning in common,
the next one's are the text's from there on. A text's tokens are those of its chunks, less what each pair of neighbours has
on the wrong sides of such a place. Where an overlap has no such place (a word longer than it), the text is cut again with
overlaps of four times the length, until its neighbours meet or one chunk holds it.

A null or empty text has no tokens. Rows are counted one by one, so repeated rows and ids and null ids are counted like
others; columns that are not kept are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.llm.bpe import tokenizer, unit_starts
from hexweave.llm.tables import cut_texts
from hexweave.llm.text import Texts, chunks
from hexweave.storage import cut

#: Bytes above which a text is cut; characters between the beginnings of chunks; characters that two chunks share.
HUGE, STRIDE, OVERLAP = 1 << 15, 1 << 14, 1 << 9
#: Tokens above which a text is over the limit.
LIMIT = 512
#: Bytes of text whose units are told apart at a time; units that a worker remembers, and the bytes of the longest of them.
BLOCK, KNOWN, UNIT_BYTES = 1 << 21, 1 << 20, 64


def margin(path: str) -> int:
    """Characters before a chunk's end in which its words may differ from the text's: the look-ahead of the scan (a
    contraction of three characters, a white space run and what ends it) and a special token less its last character."""
    return max(4, *(len(x.content) for x in tokenizer(path).get_added_tokens_decoder().values()))


class UnitCounts:
    """Numbers of tokens of units, remembered up to a bound."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def of(self, texts: Texts) -> np.ndarray:
        """The number of tokens of each text."""
        starts = unit_starts(texts)
        if not len(starts):
            return np.zeros(texts.n, np.int64)
        ends = np.append(starts, len(texts.data)).astype(np.int32)
        told = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(texts.data))]).dictionary_encode()
        units = told.dictionary.to_pylist()
        counts = [self.known.get(u) for u in units]
        new = [i for i, n in enumerate(counts) if n is None]
        encoded = tokenizer(self.path).encode_batch_fast([units[i].decode("utf-8", "replace") for i in new], add_special_tokens=False)
        if len(self.known) > KNOWN:
            self.known.clear()
        for i, e in zip(new, encoded):
            counts[i] = len(e)
            if len(units[i]) <= UNIT_BYTES:
                self.known[units[i]] = counts[i]
        sums = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[told.indices.to_numpy()])])
        first = np.searchsorted(starts, texts.offsets)
        return sums[first[1:]] - sums[first[:-1]]


_counters: dict[str, UnitCounts] = {}


def pieces_of(text: str, stride: int, overlap: int) -> list[str]:
    """Chunks of `stride` + `overlap` characters, one each `stride`; the last one reaches the end."""
    return [text[at : at + stride + overlap] for at in range(0, max(1, len(text) - overlap), stride)]


def text_of(pieces: list[str], stride: int) -> str:
    return "".join([*(p[:stride] for p in pieces[:-1]), pieces[-1]])


def _first_pass(docs: DataFrame, path: str, keep: list[str], huge: int, stride: int, overlap: int) -> DataFrame:
    """(kept, row, n_bytes, n_tokens, pieces): a huge text has pieces in place of n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, UnitCounts(path))
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, texts in chunks(b.column(1), BLOCK):
                sizes = np.diff(texts.offsets)
                large = sizes > huge
                pieces: list[list[str] | None] = [None] * texts.n
                for i in np.flatnonzero(large):
                    pieces[i] = pieces_of(texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode("utf-8", "replace"), stride, overlap)
                small = Texts(texts.data[np.repeat(~large, sizes)], np.concatenate([[0], np.cumsum(np.where(large, 0, sizes))])) if large.any() else texts
                counts = pa.array(counter.of(small), mask=large)
                rows = pa.array(row + np.arange(texts.n))
                row += texts.n
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, texts.n), rows, pa.array(sizes), counts, pa.array(pieces, pa.list_(pa.string()))], names=["kept", "row", "n_bytes", "n_tokens", "pieces"])

    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, row long, n_bytes long, n_tokens long, pieces array<string>")


def _beginnings(pieces: DataFrame, path: str, stride: int, overlap: int) -> DataFrame:
    """(row, k, n, left, left_before, right, right_before) of chunks (row, k, last, piece): number of tokens, and where
    words begin in the overlaps with the chunks before and behind, with the number of tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_end = margin(path)
        for b in batches:
            columns: list[list] = [[] for _ in range(5)]
            rows, ks, lasts, texts = (b.column(c).to_pylist() for c in ("row", "k", "last", "piece"))
            for k, last, text in zip(ks, lasts, texts):
                e = tokenizer(path).encode(text, add_special_tokens=False)
                first = np.flatnonzero(np.diff(np.array(e.word_ids, np.int64), prepend=-1))
                at = np.array([x for x, _ in e.offsets], np.int64)[first]
                left = at <= overlap if k else np.zeros(len(at), bool)
                right = (at >= stride) & (at <= stride + overlap - near_end) if k < last else np.zeros(len(at), bool)
                for column, value in zip(columns, (len(e), at[left] + k * stride, first[left], at[right] + k * stride, first[right])):
                    column.append(value)
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["row", "k", "n", "left", "left_before", "right", "right_before"])

    longs = ", ".join(f"{c} array<long>" for c in ("left", "left_before", "right", "right_before"))
    return pieces.mapInArrow(run, f"row long, k int, n long, {longs}")


def splice(told: DataFrame) -> DataFrame:
    """(row, n_tokens): null where two neighbouring chunks have no beginning in common."""
    before = told.select("row", (F.col("k") + 1).alias("k"), F.col("n").alias("n_earlier"), "right", "right_before")
    joint = told.filter("k > 0").select("row", "k", "left", "left_before").join(before, ["row", "k"]).withColumn("place", F.array_max(F.array_intersect("left", "right")))

    def at_place(places: str, counts: str) -> F.Column:
        return F.get(counts, (F.array_position(places, F.col("place")) - 1).cast("int"))

    # Of both sides of the place, what the chunk there does not own.
    joint = joint.select("row", (-(F.col("n_earlier") - at_place("right", "right_before") + at_place("left", "left_before"))).alias("n"), F.col("place").isNull().alias("open"))
    both = told.select("row", "n", F.lit(False).alias("open")).unionByName(joint)
    return both.groupBy("row").agg(F.sum("n").alias("n"), F.bool_or("open").alias("open")).select("row", F.when(~F.col("open"), F.col("n")).alias("n_tokens"))


def _recut(rows: DataFrame, old: int, stride: int, overlap: int) -> DataFrame:
    """(row, pieces) with other strides and overlaps."""

    @F.arrow_udf("array<string>")
    def again(column: pa.Array) -> pa.Array:
        return pa.array([pieces_of(text_of(x, old), stride, overlap) for x in column.to_pylist()], pa.list_(pa.string()))

    return rows.select("row", again("pieces").alias("pieces"))


def count_tokens(docs: DataFrame, path: str, keep: list[str], huge: int = HUGE, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns, n_bytes and n_tokens of each row's `text`."""
    if tokenizer(path).normalizer is not None or tokenizer(path).post_processor is not None:
        raise ValueError(f"{path} changes texts or offsets")
    rows = cut_texts(_first_pass(docs, path, keep, huge, stride, overlap))
    whole = rows.filter("pieces IS NULL").select("kept.*", "n_bytes", "n_tokens")
    open_ = rows.filter("pieces IS NOT NULL").select("row", "pieces")
    found = []
    while not open_.isEmpty():
        each = open_.select("row", (F.size("pieces") - 1).alias("last"), F.posexplode("pieces").alias("k", "piece")).repartition("row", "k")
        told = cut(splice(cut_texts(_beginnings(each, path, stride, overlap))))
        found.append(told.filter("n_tokens IS NOT NULL"))
        left = open_.join(told.filter("n_tokens IS NULL").select("row"), "row", "left_semi")
        old, overlap = stride, 4 * overlap
        stride = max(stride, 2 * overlap)
        open_ = cut_texts(_recut(left, old, stride, overlap))
    if not found:
        return whole
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    spliced = rows.filter("pieces IS NOT NULL").select("kept", "row", "n_bytes").join(counts, "row")
    return whole.unionByName(spliced.select("kept.*", "n_bytes", "n_tokens"))
