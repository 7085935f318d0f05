"""Byte-level BPE by a table of distinct words.

A word here is a run of white space with the text that follows it, up to where ASCII letters, digits and signs change if
the tokenizer's scan ends words there. No token reaches across these places, so words encode alone as they do in their
text. Rows are split into words chunk by chunk: a row keeps its words' places in its chunk's list of distinct words, most
frequent words first. The lists are grouped by word into one table of the corpus's distinct words, in which each is encoded
once, whatever its length or use, and decoded by a join of its ids with the table of pieces. The grouped rows keep a word's
places in the lists, so the ids go from there to the chunks, a task's words of a chunk in one compressed row, and are put
at their places. Rows are written in buckets by chunk, so their places are not shuffled; a word's bytes go back to chunks
only where decoding changes them.

A word is shuffled once a chunk, however often it occurs there, so the most frequent word has a row a chunk. Chunks hold
about CHUNK characters of text or one longer text, which bounds what a task holds.

Null texts count as empty and have no tokens. Special tokens in a text are encoded as the tokenizer does by default.
Rows are encoded one by one, so repeated rows and ids and null ids are encoded like others; columns that are not kept are
not looked at, and kept ones may have any name but those of the results. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.llm.tables import cut_buckets
from hexweave.llm.text import Texts, chunks
from hexweave.storage import cut

#: Characters of text in a chunk, unless one text is longer.
CHUNK = 1 << 24
#: Words of lists whose ids a task holds until they go to their chunks; places of rows that are filled in at a time.
HELD, FILLED = 1 << 18, 1 << 18
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Other white space of Unicode.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: 1 for ASCII signs, 2 for letters, 3 for digits; 0 for white space, controls and what is not ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, read once a worker; truncation and padding are unused."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


def byte_chars() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    key = f"pieces {path}"
    if key not in _loaded:
        vocab, chars = tokenizer(path).get_vocab(with_added_tokens=True), byte_chars()
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in chars for c in token)
            out[i] = bytes(chars[c] for c in token) if known else token.encode()
        _loaded[key] = out
    return _loaded[key]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the bytes of each id, of the vocabulary's size."""
    return spark.createDataFrame(list(enumerate(pieces(path))), "id int, piece binary")


def unit_starts(texts: Texts) -> np.ndarray:
    """Where each unit begins: at a text, and at ASCII white space that no white space precedes."""
    white = _ASCII_WHITE[texts.data]
    begin = white.copy()
    begin[1:] &= ~white[:-1]
    if (texts.data >= 0x80).any():
        raw = texts.data.tobytes()
        for wide in (w for w in _WIDE if w[:1] in raw):
            at = raw.find(wide)
            while at >= 0:
                begin[at + len(wide) : at + len(wide) + 1] = False
                at = raw.find(wide, at + len(wide))
    begin[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    return np.flatnonzero(begin)


def whole_tokens(path: str) -> list[bytes] | None:
    """Added tokens, which stay whole, if the tokenizer's words end where ASCII letters, digits and signs change, as the
    byte-level scan's do; else None."""
    from tokenizers import pre_tokenizers

    own = tokenizer(path)
    scan = own.pre_tokenizer
    if not isinstance(scan, pre_tokenizers.ByteLevel) or not scan.use_regex or scan.add_prefix_space or own.normalizer is not None:
        return None
    return [x.content.encode() for x in own.get_added_tokens_decoder().values()]


def word_starts(texts: Texts, whole: list[bytes] | None) -> np.ndarray:
    """Where each word begins: at a unit, and in it where kinds of ASCII characters change, but in tokens that stay whole.

    A sign is no end before a letter if it is an apostrophe, which may begin a contraction. Without `whole`, at units alone.
    """
    units = unit_starts(texts)
    if whole is None or not len(units):
        return units
    kind = _KIND[texts.data]
    begin = np.zeros(len(kind), bool)
    begin[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((texts.data[:-1] == 39) & (kind[1:] == 2))
    raw = texts.data.tobytes()
    for content in whole:
        at = raw.find(content)
        while at >= 0:
            begin[at + 1 : at + len(content)] = False
            at = raw.find(content, at + 1)
    begin[units] = True
    return np.flatnonzero(begin)


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number's end) of numbers from 0: seven bits a byte, lowest first, all but a number's last byte marked."""
    numbers = numbers.astype(np.int64)
    width = np.ones(len(numbers), np.int64)
    for k in range(1, 5):
        width += numbers >= 1 << 7 * k
    ends = np.cumsum(width)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        at = np.flatnonzero(width > k)
        out[ends[at] - width[at] + k] = (numbers[at] >> 7 * k) & 127 | np.where(width[at] > k + 1, 128, 0)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of pack."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, 5):
        at = np.flatnonzero(ends - starts >= k)
        out[at] |= (data[starts[at] + k] & 127).astype(np.int64) << 7 * k
    return out


def _strings(data: np.ndarray | pa.Buffer, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """The byte strings between successive offsets."""
    offsets = offsets.astype(np.int32 if kind in (pa.binary(), pa.string()) else np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets), data if isinstance(data, pa.Buffer) else pa.py_buffer(np.ascontiguousarray(data))])


def split_words(docs: DataFrame, keep: list[str], size: int = CHUNK, path: str | None = None) -> DataFrame:
    """(kept, chunk, places, words): packed numbers of a row's words in its chunk's list `words`.

    `kept` is a struct of the kept columns. The first row of a chunk has the list, sorted by use and then by word; the
    others' are empty. Words are whole units where no tokenizer is given.
    """
    whole = None if path is None else whole_tokens(path)

    def split(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of some texts, and each text's first one."""
        _, texts = next(chunks(column, 1 << 62))
        starts = word_starts(texts, whole)
        return _strings(texts.data, np.append(starts, len(texts.data))).dictionary_encode(), np.searchsorted(starts, texts.offsets)

    def chunk(number: int, kept: list[pa.Array], parts: list[tuple[pa.DictionaryArray, np.ndarray]]) -> pa.RecordBatch:
        coded = pa.chunked_array([x for x, _ in parts]).unify_dictionaries()
        words = coded.chunk(0).dictionary.cast(pa.string())
        uses = sum(np.bincount(x.indices.to_numpy(), minlength=len(words)) for x in coded.chunks)
        order = pc.sort_indices(words).to_numpy()
        order = order[np.argsort(-uses[order], kind="stable")]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        places = []
        for x, (_, first) in zip(coded.chunks, parts):
            data, ends = pack(rank[x.indices.to_numpy()])
            places.append(_strings(data, np.concatenate([[0], ends])[first]))
        n = sum(len(x) for x in kept)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(n, len(words))), pa.int32()), words.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(kept), pa.array(np.full(n, number)), pa.concat_arrays(places), lists], names=["kept", "chunk", "places", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        kept, parts = [], []
        for b in batches:
            begin = 0
            for i, n in enumerate([*pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist(), 0]):
                full = (kept or i > begin) and held + n > size
                if (full or i == b.num_rows) and i > begin:
                    kept.append(b.column(0).slice(begin, i - begin))
                    parts.append(split(b.column(1).slice(begin, i - begin)))
                    begin = i
                if full:
                    yield chunk(number, kept, parts)
                    kept, parts, held, number = [], [], 0, number + 1
                    pa.default_memory_pool().release_unused()
                held += n
        if kept:
            yield chunk(number, kept, parts)

    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, chunk long, places binary, words array<string>")


def _meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens (row, at, id, piece, told), in their order, as rows (told, tokens, decoded), a row's tokens together."""
    rest: list[pa.RecordBatch] = []

    def rows(table: pa.Table) -> pa.RecordBatch:
        row = table.column("row").to_numpy()
        begin = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
        ends = np.append(begin, len(row))
        if (np.diff(row) < 0).any() or (table.column("at").to_numpy() != np.arange(len(row)) - np.repeat(begin, np.diff(ends))).any():
            raise ValueError("tokens are out of their order")
        told = table.column("told").take(pa.array(begin)).combine_chunks()
        ids, parts = table.column("id").combine_chunks(), table.column("piece").combine_chunks()
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
        return pa.RecordBatch.from_arrays([told, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), _strings(parts.buffers()[2], offsets[ends])], names=["told", "tokens", "decoded"])

    for b in batches:
        if not b.num_rows:
            continue
        row = b.column("row").to_numpy()
        last = int(np.searchsorted(row, row[-1]))
        if rest and (last or rest[-1].column("row")[0].as_py() != row[-1]):
            yield rows(pa.Table.from_batches([*rest, b.slice(0, last)]))
            rest = []
        elif last:
            yield rows(pa.Table.from_batches([b.slice(0, last)]))
        rest.append(b.slice(last))
    if rest:
        yield rows(pa.Table.from_batches(rest))


def _word_tokens(words: DataFrame, path: str, *told: Column) -> tuple[DataFrame, str]:
    """Rows for _meet_again of each distinct word's tokens, where `told` has the word and aggregates of its rows; and told's type.

    Each word is encoded once, where its rows meet; its ids join the table of pieces there.
    """

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        ids = [e.ids for e in tokenizer(path).encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])))

    encode = ids_of.asNondeterministic()  # else a filter on its result is moved before the distinct words, and repeats it
    grouped = words.repartition("word").groupBy("word").agg(*told)  # a list has a word once, so tasks have nothing to sum up before
    encoded = grouped.select(F.struct("*").alias("told"), encode("word").alias("ids")).withColumn("row", F.monotonically_increasing_id())
    placed = encoded.select("row", "told", F.posexplode("ids").alias("at", "id")).withColumn("told", F.when(F.col("at") == 0, F.col("told")))
    pieced = placed.join(F.broadcast(piece_table(words.sparkSession, path)), "id").select("row", "at", "id", "piece", "told")
    return pieced, pieced.schema["told"].dataType.simpleString()


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids, decoded) of each distinct word: number of tokens, ids as decimals joined by commas, and bytes."""
    tokens, kind = _word_tokens(words, path, F.count("*").alias("rows"))
    said = tokens.mapInArrow(_meet_again, f"told {kind}, tokens array<int>, decoded binary")
    ids = F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").cast("binary")
    return said.select("told.word", F.size("tokens").alias("n"), ids.alias("ids"), "decoded")


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens for _meet_again, told with words and their places in chunks' lists, as rows of a chunk: its words' packed places
    and numbers of tokens, and ids, compressed; and bytes of words that decoding changes."""
    codec = pa.Codec("zstd", compression_level=3)
    names = ["list", "sizes", "at", "n", "ids", "other_at", "other"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]

    def rows(table: pa.Table) -> pa.RecordBatch:
        told, tokens, decoded = (table.column(c).combine_chunks() for c in ("told", "tokens", "decoded"))
        where = told.field("places")
        word = np.repeat(np.arange(len(where)), where.value_lengths().to_numpy())
        listed, at = (where.flatten().field(i).to_numpy() for i in (0, 1))
        changed = pc.not_equal(told.field("word").cast(pa.binary()), decoded).to_numpy(zero_copy_only=False)
        order = np.lexsort((at, listed))
        word, listed, at = word[order], listed[order], at[order]
        edges = np.append(np.flatnonzero(np.diff(listed, prepend=listed[0] - 1)), len(listed))
        columns: list[list] = [[] for _ in names]
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = tokens.take(pa.array(word[lo:hi]))
            raw = [pack(np.diff(at[lo:hi], prepend=0))[0], pack(own.value_lengths().to_numpy())[0], own.flatten().to_numpy().astype("<u4").view("u1").reshape(-1, 4).T]
            far = np.flatnonzero(changed[word[lo:hi]]) + lo
            values = [listed[lo], [x.size for x in raw], *(codec.compress(np.ascontiguousarray(x), asbytes=True) for x in raw), at[far].tolist(), decoded.take(pa.array(word[far])).to_pylist()]
            for column, value in zip(columns, values):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    some: list[pa.RecordBatch] = []
    held = 0
    for b in _meet_again(batches):
        some.append(b)
        held += len(b.column("told").field("places").flatten())
        if held > HELD:
            yield rows(pa.Table.from_batches(some))
            some, held = [], 0
            pa.default_memory_pool().release_unused()
    if some:
        yield rows(pa.Table.from_batches(some))


def _put_in_place(keep: list[str]):
    """A chunk's rows and its list of words, with what the word table says of them, to digests of each row."""

    def joined(strings: pa.Array, own: np.ndarray, first: np.ndarray, less: int) -> list[memoryview]:
        """The strings of each row's places, one after the other, without the last `less` bytes."""
        taken = strings.take(pa.array(own))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[first].tolist() if len(own) else [0] * len(first)
        data = memoryview(taken.buffers()[2] or b"")
        return [data[a : max(a, z - less)] for a, z in zip(ends[:-1], ends[1:])]

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        listed = rows.column("words").combine_chunks().flatten()
        at, n, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for sizes, *raw in zip(*(words.column(c).to_pylist() for c in ("sizes", "at", "n", "ids"))):
            some, counts, planes = (np.frombuffer(pa.decompress(x, s, "zstd"), np.uint8) if s else np.zeros(0, np.uint8) for x, s in zip(raw, sizes))
            at.append(np.cumsum(unpack(some)))
            n.append(unpack(counts))
            ids.append(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel())
        at, n, ids = np.concatenate(at), np.concatenate(n), np.concatenate(ids)
        order = np.argsort(at)
        if not np.array_equal(at[order], np.arange(len(listed))):
            raise ValueError("words of a chunk's list have no ids, or several")
        decimals = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", ","))).cast(pa.large_binary())
        starts = np.frombuffer(decimals.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        said = _strings(decimals.buffers()[2] or pa.py_buffer(b""), starts[np.concatenate([[0], np.cumsum(n)])], pa.large_binary()).take(pa.array(order))
        n = n[order]
        text = listed.cast(pa.large_binary())
        far = dict(pair for some, other in zip(words.column("other_at").to_pylist(), words.column("other").to_pylist()) for pair in zip(some, other))
        if far:
            mask = np.zeros(len(listed), bool)
            mask[list(far)] = True
            text = pc.replace_with_mask(text, pa.array(mask), pa.array([far[i] for i in sorted(far)], pa.large_binary()))
        places = rows.column("places").combine_chunks()
        sizes = pc.binary_length(places).to_numpy()
        counts, ids_sha, text_sha = [], [], []
        parts = np.cumsum(sizes) // FILLED
        for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(parts)) + 1) if len(places) else []:
            packed = np.frombuffer(b"".join(places.slice(part[0], len(part)).to_pylist()), np.uint8)
            own = unpack(packed)
            before = np.concatenate([[0], np.cumsum(packed < 128)])
            first = before[np.concatenate([[0], np.cumsum(sizes[part])])]
            sums = np.concatenate([[0], np.cumsum(n[own])])
            counts += (sums[first[1:]] - sums[first[:-1]]).tolist()
            ids_sha += [hashlib.sha256(x).hexdigest() for x in joined(said, own, first, 1)]
            text_sha += [hashlib.sha256(bytes(x).decode("utf-8", "replace").encode()).hexdigest() for x in joined(text, own, first, 0)]
        pa.default_memory_pool().release_unused()
        kept = rows.column("kept").combine_chunks()
        columns = [kept.field(i) for i in range(len(keep))]
        return pa.table([*columns, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def words_of_chunks(split: DataFrame, path: str) -> DataFrame:
    """What the word table says of each chunk's words, packed: see _by_chunk."""
    listed = split.select("chunk", F.posexplode("words").alias("at", "word"))
    tokens, _ = _word_tokens(listed, path, F.collect_list(F.struct("chunk", "at")).alias("places"))
    return tokens.mapInArrow(_by_chunk, "list long, sizes array<int>, at binary, n binary, ids binary, other_at array<int>, other array<binary>")


def encode_documents(docs: DataFrame, path: str, keep: list[str], size: int = CHUNK) -> DataFrame:
    """The kept columns, n_tokens, and the SHA-256 of the ids (decimals joined by commas) and of the decoded text."""
    split = cut_buckets(split_words(docs, keep, size, path), "chunk", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = words_of_chunks(split, path)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return split.groupBy("chunk").cogroup(words.groupBy("list")).applyInArrow(_put_in_place(keep), f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The kept columns and the ids themselves, as an array, without a word table: for small inputs and for decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [e.ids for e in tokenizer(path).encode_batch([t or "" for t in b.column(len(keep)).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    rows = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The kept columns and the text of `ids`: places join the id-to-piece table, of the vocabulary's size, and meet again.

    Null and empty ids give an empty text; bytes that are no UTF-8 give U+FFFD. An id outside the vocabulary is dropped.
    """
    table = piece_table(encoded.sparkSession, path)
    rows = encoded.select(*keep, F.monotonically_increasing_id().alias("_row"), "ids")
    rows = cut(rows)
    placed = rows.select("_row", F.posexplode("ids").alias("_at", "id")).join(F.broadcast(table), "id")
    hexed = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_at", F.hex("piece").alias("h")))), lambda x: x.h))
    texts = placed.groupBy("_row").agg(F.decode(F.unhex(hexed), "UTF-8").alias("text"))
    return rows.join(texts, "_row", "left").select(*keep, F.coalesce("text", F.lit("")).alias("text"))
