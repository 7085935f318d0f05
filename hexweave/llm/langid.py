"""Language by words first, then by shorter and shorter character n-grams.

A term (letters, digits, and all that is not ASCII) that the training sample has at least twice is scored by its log
frequency in each language. An unseen term is scored by its known 5-grams of characters; if it has none, by its 4-grams,
and so on to single characters. A text's language has the largest mean over its terms.

`und`, with score 0, for a null text and one without a letter. A text with letters always has a learned language.
Rows whose `lang` is null teach nothing; without any that does, every text is `und`. Rows are told one by one, so
repeated rows and null ids are told like others; rows that repeat a doc_id in a language teach it each. Every language
with a row to learn from is learned, however rare. Very long texts are scored whole; columns other than doc_id, lang and
text are not looked at, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexweave.llm.tables import fold, map_texts, text_struct
from hexweave.llm.text import Texts, chunks, mix, of_text, text_sums

#: Ids of each language that the model is fitted on, in an order by hash.
PER_LANGUAGE = 750
#: A language's ids are cut to about this many times those before they are ranked, by a bound on the hash.
SPARE = 3
ORDERS = (5, 4, 3, 2, 1)
#: How often the sample has a term or an n-gram of two characters and more that is known.
LEAST_TIMES = 2
UND = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_U = np.uint64


@dataclass
class Table:
    """Hash to log frequency in each language, by search among sorted hashes."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each hash, whether it is known)."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> "Table":
        """From distinct hashes and how often each language has them (a column a language)."""
        if not len(keys):
            return cls(np.zeros(1, _U), np.zeros((1, counts.shape[1]), np.float32))
        logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(keys)))
        order = np.argsort(keys)
        return cls(keys[order], logs[order].astype(np.float32))


def ngrams(texts: Texts, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the span) of all grams of n characters of the spans."""
    begin, before = texts.characters
    first = before[starts]
    room = np.maximum(before[ends] - first - n + 1, 0)
    of = np.repeat(np.arange(len(starts)), room)
    at = np.arange(len(of)) - np.repeat(np.cumsum(room) - room, room) + first[of]
    return mix(texts.span_hash(begin[at], begin[at + n], True) + _U(n)), of


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: dict[int, Table]

    def score(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        terms = texts.terms
        at, known = self.words.find(terms.lower)
        logs = np.where(known[:, None], self.words.logs[at], 0)
        open_ = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(open_):
                break
            h, of = ngrams(texts, terms.starts[open_], terms.ends[open_], n)
            at, hit = self.grams[n].find(h)
            at, of = at[hit], of[hit]
            times = np.bincount(of, minlength=len(open_))
            got = np.stack([np.bincount(of, weights=self.grams[n].logs[at, k], minlength=len(open_)) for k in range(len(self.langs))], axis=1)
            done = times > 0
            logs[open_[done]] = got[done] / times[done, None]
            open_ = open_[~done]
        mean = np.stack([text_sums(logs[:, k], terms.first) for k in range(len(self.langs))], axis=1) / np.maximum(terms.counts, 1)[:, None]
        p = np.exp(20 * (mean - mean.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        lettered = texts.per_text(_LETTER[texts.data]) > 0
        for i in np.flatnonzero(~lettered):
            raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
            lettered[i] = not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace"))
        best = p.argmax(1)
        return [self.langs[k] if ok else UND for k, ok in zip(best, lettered)], np.where(lettered, p[np.arange(len(p)), best], 0.0)


def counted(texts: Texts) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{order: (hash, index of its text)}; order 0 has the terms, the others n-grams of each text's distinct terms.

    Frequent words are known anyway, so their repeats need not weigh on the n-grams.
    """
    terms = texts.terms
    out = {0: (terms.lower, terms.doc)}
    distinct = np.unique(of_text(terms.lower, terms.doc), return_index=True)[1]
    for n in ORDERS:
        h, of = ngrams(texts, terms.starts[distinct], terms.ends[distinct], n)
        out[n] = h, terms.doc[distinct[of]]
    return out


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], DataFrame]:
    """(languages, (lang, text) of at most `per_language` ids of each outside the held-out fold, in an order by hash).

    Languages are counted first; those with many ids are cut by a bound on the hash, so that what is ranked together
    does not grow with the rows or tasks. The chosen ids, at most `per_language` times the languages, are what is broadcast.
    """
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    sizes = sorted((r.lang, r.n) for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect())
    bounds = [(lang, min((1 << 63) - 1, (1 << 63) * SPARE * per_language // max(n, 1))) for lang, n in sizes]
    below = docs.sparkSession.createDataFrame(bounds, "lang string, below long")
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    near = known.select("lang", "doc_id", order.alias("at")).join(F.broadcast(below), "lang").filter("at <= below").select("lang", "doc_id", "at").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))
    ids = near.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "doc_id")
    return [lang for lang, _ in sizes], known.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """From a bounded number of labelled rows of each language; None without any.

    Tasks count; the driver gets a row for each hash that occurs often enough.
    """
    langs, rows = training_rows(docs, per_language)
    if not langs:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([langs.index(x) for x in b.column(0).to_pylist()], dtype=_U)
            for lo, texts in chunks(b.column(1)):
                for n, (h, of) in counted(texts).items():
                    for k in np.unique(own[lo : lo + texts.n]):
                        keys, times = np.unique(h[own[lo + of] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(np.full(len(keys), int(k), np.int32)), pa.array(keys.view(np.int64)), pa.array(times)], names=["n", "k", "h", "times"])

    each = [F.sum(F.when(F.col("k") == k, F.col("times")).otherwise(0)).alias(f"c{k}") for k in range(len(langs))]
    counts = rows.mapInArrow(count, "n int, k int, h long, times long").groupBy("n", "h").agg(*each)
    got = counts.filter((F.col("n") == 1) | (sum(F.col(f"c{k}") for k in range(len(langs))) >= LEAST_TIMES)).toArrow()
    order, keys = got.column("n").to_numpy(), got.column("h").to_numpy().view(_U)
    by_lang = np.stack([got.column(f"c{k}").to_numpy() for k in range(len(langs))], axis=1)
    tables = {n: Table.of(keys[order == n], by_lang[order == n]) for n in (0, *ORDERS)}
    return Model(langs, tables.pop(0), tables)


VERDICT = "lang_pred string, lang_score double"


def _kernel(spark: SparkSession, model: Model | None) -> Callable[[Texts], dict]:
    shared = spark.sparkContext.broadcast(model)

    def kernel(texts: Texts) -> dict:
        lang, score = shared.value.score(texts) if shared.value else ([UND] * texts.n, np.zeros(texts.n))
        return {"lang_pred": lang, "lang_score": score}

    return kernel


def verdict(spark: SparkSession, model: Model | None) -> Column:
    """A struct of lang_pred and lang_score of a row's `text`."""
    return text_struct(VERDICT, _kernel(spark, model))


def identify(docs: DataFrame, keep: list[str], model: Model | None) -> DataFrame:
    """The kept columns, lang_pred and lang_score of each row."""
    return map_texts(docs, keep, VERDICT, _kernel(docs.sparkSession, model))


def language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    return identify(docs, ["doc_id"], fit(docs, per_language)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
