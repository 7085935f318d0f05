"""License notices by an exact set-similarity join, in DataFrame expressions alone.

Words are runs of ASCII digits, letters and all that is not ASCII, A-Z in lower case. A text block is a line. Each
template is a set of tokens, and a line meets it where it holds THRESHOLD of them or more. Tokens are ordered by the
number of lines that hold them, in the whole corpus, rarest first: a line that meets a template of n tokens holds one
of its first n - ceil(THRESHOLD * n) + 1 (prefix filter) and has tokens enough (length filter), and what may still
match after the first common token reaches the threshold (positional filter). Every line left is verified.

Notices are hard-wrapped too, so runs of successive words that go across lines are blocks as well: as many words as
SLACK times the template has, for comment marks and insertions. A run's document holds the run's tokens, so documents
go through the same filters first, with tokens ordered by the number of documents that hold them; in those left, every
run that begins with a token is verified.

Null texts count as empty: no words, no labels, score 0. Each row is a document of its own: rows that repeat a doc_id
with other texts share no lines, and rows with a null doc_id have their labels. Rows alike in id and text are looked at
once. Very long lines and texts are blocks like others. Other columns are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexweave.storage import cut

THRESHOLD = 0.9
#: How many times the words of a template a run across lines has.
SLACK = 2
# Phrases whose words must stand consecutively, and the label of each.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Label and text of each template. Words of STOP count in no template.
STOP = "a and as be by for in is it of on or that the this to under with".split()
TEMPLATES = {
    "mit": "released under the MIT License",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the Apache License Version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-2": "licensed under the GNU General Public License version 2",
    "gpl-3": "licensed under the GNU General Public License version 3",
    "lgpl-3": "licensed under the GNU Lesser General Public License version 3",
    "mpl-2": "subject to the terms of the Mozilla Public License version 2.0",
    "cc-by-4": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "licensed under CC BY-NC 4.0",
    "cc-by-sa": "licensed under CC BY-SA 4.0",
    "cc0": "dedicated to the public domain under CC0 1.0 Universal",
}
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _hits(found: Column, phrase: str) -> Column:
    """Places of a phrase in an array of words."""
    parts = phrase.split()

    def at(i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & (F.translate(F.get(found, i + k), _UPPER, _SMALL) == part)
        return same

    return F.filter(F.sequence(F.lit(0), F.size(found)), at)


#: What names a row's text in joins: its id, never null, and a hash of the text. Rows alike in both have equal results.
ROW = ("id", "of_text")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, of_text, text)"""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("of_text"), "text")


def phrase_hits(docs: DataFrame) -> DataFrame:
    """(doc_id, id, of_text, n_words, n_base, first_word, last_word, base) of each row; places are sought only where a cheap pattern allows."""
    any_phrase = "(?i)" + "|".join(_GAP.join(p.split()) for p in PHRASES)
    rows = docs.select("doc_id", *ROW, F.col("text").rlike(any_phrase).alias("may"), words("text").alias("words"))
    none = F.array().cast("array<int>")
    for k, phrase in enumerate(PHRASES):
        rows = rows.withColumn(f"hits_{k}", F.when(F.col("may"), _hits(F.col("words"), phrase)).otherwise(none))
    all_hits = F.concat(*[F.col(f"hits_{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"hits_{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    return rows.select(
        "doc_id",
        *ROW,
        F.when(F.col("words").isNull(), 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.size(all_hits).cast("long").alias("n_base"),
        F.array_min(all_hits).cast("long").alias("first_word"),
        F.array_max(all_hits).cast("long").alias("last_word"),
        labels.alias("base"),
    )


def template_tokens(docs: DataFrame) -> DataFrame:
    """(label, token, size): at most some hundred rows."""
    spark = docs.sparkSession
    texts = spark.createDataFrame(list(TEMPLATES.items()), "label string, text string")
    tokens = texts.select("label", F.explode(F.array_distinct(words(F.lower("text")))).alias("token")).filter(~F.col("token").isin(STOP))
    sizes = tokens.groupBy("label").agg(F.count("*").alias("size"))
    return tokens.join(sizes, "label")


def _candidates(held: DataFrame, templates: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, label, size, need): the blocks that may meet a template, of the distinct tokens (block, token) that they hold."""
    order = F.row_number().over(Window.partitionBy("label").orderBy("blocks", "token"))
    frequency = held.groupBy("token").agg(F.count("*").alias("blocks"))
    ranked = cut(templates.join(frequency, "token", "left").fillna(0, ["blocks"]).withColumn("place", order))
    need = F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)).cast("int")
    prefix = ranked.withColumn("need", need).filter(F.col("place") <= F.col("size") - F.col("need") + 1)
    n_tokens = held.groupBy(*block).agg(F.count("*").alias("n_tokens"))
    first = held.join(F.broadcast(prefix), "token").groupBy(*block, "label", "size", "need").agg(F.min("place").alias("place"))
    long = first.join(n_tokens, block).filter((F.col("n_tokens") >= F.col("need")) & (F.col("size") - F.col("place") + 1 >= F.col("need")))
    return long.select(*block, "label", "size", "need")


def line_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, of_text, label, containment): the lines of each document that meet a template, best line of each label."""
    templates, block = cut(template_tokens(docs)), [*ROW, "line"]
    vocabulary = templates.select("token").distinct()
    lines = docs.select(*ROW, F.posexplode(F.split("text", "\n")).alias("line", "of")).filter(F.col("of") != "")
    spoken = lines.select(*block, F.explode(words("of")).alias("word")).select(*block, F.lower("word").alias("token"), F.octet_length("word").alias("bytes"))
    held = spoken.join(F.broadcast(vocabulary), "token").filter(F.col("bytes") == F.length("token"))  # the templates' words alone
    held = cut(held.select(*block, "token").distinct())
    common = _candidates(held, templates, block, threshold).join(F.broadcast(templates.select("label", "token")), "label").join(held, [*block, "token"])
    found = common.groupBy(*block, "label", "size", "need").agg(F.count("*").alias("n")).filter(F.col("n") >= F.col("need"))
    return found.groupBy(*ROW, "label").agg(F.max(F.col("n") / F.col("size")).alias("containment"))


def reach(label: str) -> int:
    """Words of a run for a template."""
    return SLACK * len(TEMPLATES[label].replace("-", " ").replace(".", " ").split())


def wrapped_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, of_text, label, containment): the runs of words of each document, whatever its lines, that meet a template."""
    templates = cut(template_tokens(docs))
    vocabulary = templates.select("token").distinct()
    spoken = docs.select(*ROW, F.posexplode(words("text")).alias("at", "word"))
    said = spoken.select(*ROW, "at", F.lower("word").alias("token"), F.octet_length("word").alias("bytes"))
    held = said.join(F.broadcast(vocabulary), "token").filter(F.col("bytes") == F.length("token"))
    held = cut(held.select(*ROW, "at", "token").distinct())  # of rows alike in id and text once
    may = _candidates(held.select(*ROW, "token").distinct(), templates, [*ROW], threshold)
    tokens = held.join(cut(may), [*ROW]).join(F.broadcast(templates.select("label", "token")), ["label", "token"])
    run = Window.partitionBy(*ROW, "label").orderBy("at").rangeBetween(0, max(map(reach, TEMPLATES)) - 1)
    runs = tokens.withColumn("run", F.collect_list(F.struct("at", "token")).over(run))
    reaches = F.create_map(*[F.lit(x) for label in TEMPLATES for x in (label, reach(label))])
    near = F.filter("run", lambda x: x["at"] < F.col("at") + reaches[F.col("label")])
    n = F.size(F.array_distinct(F.transform(near, lambda x: x["token"])))
    found = runs.select(*ROW, "label", "need", n.alias("n"), "size").filter(F.col("n") >= F.col("need"))
    return found.groupBy(*ROW, "label").agg(F.max(F.col("n") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    docs = _keyed(docs)
    matches = line_matches(docs, threshold).unionByName(wrapped_matches(docs, threshold))
    lines = cut(matches.groupBy(*ROW).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))  # of TEMPLATES labels at most
    rows = phrase_hits(docs).join(lines, [*ROW], "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort(F.array_distinct("base"))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none))))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
