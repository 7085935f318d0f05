"""How the words of a language's sources differ: divergences of all pairs of sources, and each source's most telling terms.

Terms are runs of ASCII letters and of all that is not ASCII, A-Z lower-cased. A language keeps the terms that at least
LEAST_DOCS of its documents hold. A kept term's probability in a group (a source's documents of a language) or in the
language is a whole number of billionths, with 2 added to each count; two probabilities differ by the whole part of
(p - q) ** 2 / (p + q). Arithmetic is on whole numbers throughout: quotients by long division in two steps of 64 bits, right
for counts below 10 ** 14.

pair: postings (a term's sources with their probabilities) give what sources that share a term differ by there, in
tasks, over blocks of a bounded number of pairs. What terms of one source alone or of none add depends on the term's
count, so it comes from the number of terms with each count. term: a group's terms of one count have one probability, so
the least and the largest probability that the language gives these terms bound what they differ by. A bucket holds a
group's terms of one count whose counts in the language are alike (LEVELS to a doubling), which keeps the bounds close.
Buckets that cannot hold one of the TOP are dropped; what is left is evaluated from the largest upper bound down, until the
next bound is strictly below the last of the TOP found.

Null text, lang and source are ''. Rows are documents: repeated rows and ids count each, and no id is looked at. Ties in value
go by the item's UTF-8 bytes. A group without terms has its pairs too; where a language keeps no term these are 0. Long
texts are counted in blocks like others. An empty table gives an empty one; further columns are not looked at.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexweave.llm.text import chunks
from hexweave.storage import cut

LEAST_DOCS, TOP = 10, 10
#: Bytes of terms that a task counts together; pairs of postings that it has at a time.
FLUSH, PAIRS = 1 << 23, 1 << 19
#: Buckets of a count for each doubling of a term's count in the language.
LEVELS = 4
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): how often a group has a term, and in how many documents, as sums of what tasks count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        words, counts, of, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            told = pa.chunked_array(words, pa.binary()).dictionary_encode().combine_chunks()
            code, known = told.indices.to_numpy().astype(np.int64), max(1, len(told.dictionary))
            doc = np.repeat(np.arange(sum(map(len, counts))), np.concatenate(counts))
            pair, times = np.unique(doc * known + code, return_counts=True)
            key, at, docs_ = np.unique(np.concatenate(of)[pair // known] * known + pair % known, return_inverse=True, return_counts=True)
            n = np.bincount(at, weights=times, minlength=len(key)).astype(np.int64)
            names = pa.table(list(zip(*groups)), names=["lang", "source"]).take(key // known)
            term = told.dictionary.take(pa.array(key % known)).cast(pa.string())
            yield from pa.table([*names.columns, term, pa.array(n), pa.array(docs_)], names=["lang", "source", "term", "n", "d"]).combine_chunks().to_batches(1 << 17)

        for b in batches:
            own = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            for lo, texts in chunks(b.column(2), 1 << 20):
                terms = texts.runs(_NOT_LETTER)
                ends = np.concatenate([[0], np.cumsum(terms.ends - terms.starts)]).astype(np.int32)
                words.append(pa.Array.from_buffers(pa.binary(), len(terms.starts), [None, pa.py_buffer(ends), pa.py_buffer(texts.lowered[terms.inside])]))
                counts.append(terms.counts)
                of.append(own[lo : lo + texts.n])
                size += int(ends[-1])
                if size >= FLUSH:
                    yield from flush()
                    words, counts, of, size = [], [], [], 0
        if words:
            yield from flush()

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    made = docs.select(said("lang"), said("source"), "text").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * kept)), null where there is no kept term."""
    by = f"nullif({total} + 2 * {kept}, 0)"
    first = f"(({count} + 2) * 10000)"
    return F.expr(f"1 + ({first} div {by}) * 100000 + (({first} % {by}) * 100000) div {by}")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pairs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value), a before b: what shared terms add to what pairs of sources have from each other's counts alone."""
    lists = b.column(b.schema.get_field_index("posting"))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    known, code = np.unique(np.array([s.encode() for s in flat.field("source").to_pylist()], object), return_inverse=True)
    p, zero = flat.field("p").to_numpy(), flat.field("zero").to_numpy()
    langs, lang = np.unique(np.array(b.column(b.schema.get_field_index("lang")).to_pylist(), object), return_inverse=True)
    lang = np.repeat(lang, sizes)
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat)) - 1  # entries of the posting behind each one
    before = np.concatenate([[0], np.cumsum(later)])
    lo = 0
    while lo < len(flat):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(lo, hi), later[lo:hi])
        right = left + 1 + np.arange(len(left)) - (before[left] - before[lo])
        value = _gap(p[left], p[right]) - _gap(p[left], zero[right]) - _gap(zero[left], p[right]) + _gap(zero[left], zero[right])
        a, c = np.minimum(code[left], code[right]), np.maximum(code[left], code[right])
        key, at = np.unique((lang[left] * len(known) + a) * len(known) + c, return_inverse=True)
        total = np.bincount(at, weights=value, minlength=len(key)).astype(np.int64)  # whole numbers below 2 ** 53
        names = pa.array([k.decode() for k in known], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(langs[key // len(known) ** 2].tolist(), pa.string()), names.take(pa.array(key // len(known) % len(known))), names.take(pa.array(key % len(known))), pa.array(total)], names=["lang", "a", "b", "value"])
        lo = hi


def pair_part(stats: DataFrame, occurrences: DataFrame, buckets: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each source and each other source of its language."""
    # A term's sources; no more than the language has.
    postings = occurrences.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("posting")).select("lang", "posting").filter(F.size("posting") > 1)
    shared = postings.mapInArrow(lambda batches: (out for b in batches for out in _pairs(b)), "lang string, a string, b string, value long")
    other = stats.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    by_count = buckets.groupBy("lang", "source", "n").agg(F.min("p").alias("p"), F.min("zero").alias("zero"), F.sum("terms").alias("terms"))
    alone = by_count.select("lang", F.col("source").alias("a"), "p", "zero", "terms").join(other, "lang").filter("a <> b")
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("terms") * (gap("p", "zero_b") - gap("zero", "zero_b"))).alias("value"))
    none = stats.select("lang", F.col("source").alias("a"), "zero", "kept").join(other, "lang").filter("a < b")
    none = none.select("lang", "a", "b", F.coalesce(F.col("kept") * gap("zero", "zero_b"), F.lit(0).cast("long")).alias("value"))
    sums = shared.unionByName(alone).unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("of")
    return sums.select("lang", sides, "value").select("lang", "of.source", "of.item", "value")


def best_first(batches: Iterator[pa.RecordBatch], top: int = TOP) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value, rank) of the `top` terms of each group, from rows (lang, source, term, p, q, most) that
    stand group by group with falling upper bounds `most`. A group's rows are not evaluated once the bound is below its last
    of `top` values; equal bounds are, as a term that comes first by its bytes may have that value."""
    group, best, out = None, [], []

    def close() -> None:
        out.extend((*group, term.decode(), -v, k) for k, (v, term) in enumerate(best, 1))

    for b in batches:
        for lang, source, term, p, q, most in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "term", "p", "q", "most"))):
            if (lang, source) != group:
                if group is not None:
                    close()
                group, best = (lang, source), []
            if len(best) == top and most < -best[-1][0]:
                continue
            insort(best, (-((p - q) ** 2 // (p + q)), term.encode()))
            del best[top:]
    if group is not None:
        close()
    columns = list(zip(*out)) or [()] * 5
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "item", "value", "rank"])


def candidates(occurrences: DataFrame, buckets: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, term, p, q, most) of terms that the bounds of their buckets let into the `top`.

    `most` is a bucket's upper bound. All terms of a bucket with a lower bound have that value at least, so the largest
    one at which `top` terms have been seen is a value that no term of the `top` is below.
    """
    bound = buckets.withColumns({"most": F.when(F.col("p") > F.col("q_low"), gap("p", "q_low")), "least": F.when(F.col("p") > F.col("q_high"), gap("p", "q_high"))})
    own = Window.partitionBy("lang", "source")
    seen = F.sum("terms").over(own.orderBy(F.desc_nulls_last("least")).rowsBetween(Window.unboundedPreceding, 0))
    bound = bound.withColumn("seen", seen).withColumn("floor", F.max(F.when(F.col("seen") >= top, F.col("least"))).over(own))
    open_ = bound.filter(F.col("most").isNotNull() & (F.col("floor").isNull() | (F.col("most") >= F.col("floor")))).select("lang", "source", "n", "level", "most")
    return occurrences.filter("p > q").join(open_, ["lang", "source", "n", "level"]).select("lang", "source", "term", "p", "q", "most")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the `top` terms, of each group."""
    counts = cut(term_counts(docs))
    posted = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("posting"), F.sum("n").alias("total"), F.sum("d").alias("docs"))
    kept = cut(posted.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "posting"))
    flat = kept.select("lang", "term", "total", F.explode("posting").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    by_group = flat.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    stats = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["size", "kept", "lang_size"])
    stats = cut(stats.withColumn("zero", probability("0", "size", "kept")))
    occurrences = cut(
        flat.join(stats, ["lang", "source"])
        .withColumns({"p": probability("n", "size", "kept"), "q": probability("total", "lang_size", "kept"), "level": F.floor(LEVELS * F.log2("total")).cast("int")})
        .select("lang", "source", "term", "n", "level", "p", "q", "zero")
    )
    buckets = cut(occurrences.groupBy("lang", "source", "n", "level").agg(F.min("p").alias("p"), F.min("zero").alias("zero"), F.min("q").alias("q_low"), F.max("q").alias("q_high"), F.count("*").alias("terms")))
    pairs = pair_part(stats, occurrences, buckets)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    rows = candidates(occurrences, buckets, top).repartition("lang", "source").sortWithinPartitions("lang", "source", F.desc("most"))
    terms = rows.mapInArrow(lambda batches: best_first(batches, top), "lang string, source string, item string, value long, rank int")
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
