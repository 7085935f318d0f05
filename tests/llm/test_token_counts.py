"""Operator 11 against the tokenizers library on whole texts."""

import random

import public_tokenizers
import pytest

from hexweave.llm import registry, token_counts
from hexweave.llm.bpe import tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "é", "日", " ", "  ", " ", "\n", "\n\n", "'re", "'", "'l", "l", "<|endoftext|>", "<|endo", "1", "22", "!?", "　", "\t", "\x85", " ", "👩‍👩", "x" * 40, "lorem ", "ipsum's "]


def expected(text):
    return len((text or "").encode()), len(tokenizer(PATH).encode(text or "", add_special_tokens=False))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    said = [None, "", " ", "a" * 3000, "ab" * 5000 + " x", " " * 3000 + "y"]
    said += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")


@pytest.mark.parametrize("huge,stride,overlap", [(token_counts.HUGE, token_counts.STRIDE, token_counts.OVERLAP), (50, 60, 30), (100, 200, 40), (10, 40, 16)])
def test_counts_are_the_librarys(texts, huge, stride, overlap):
    """By units, and by chunks whose overlaps are too short for some words and are widened."""
    rows = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(texts, PATH, ["doc_id"], huge, stride, overlap).collect()}
    assert rows == {r.doc_id: expected(r.text) for r in texts.collect()}


def test_neighbours_that_do_not_meet(spark):
    """A word longer than the overlap leaves its row open, and another row is spliced."""
    docs = spark.createDataFrame([(1, "one two three " * 20), (2, "x" * 400)], "doc_id long, text string")
    rows = token_counts._first_pass(docs, PATH, ["doc_id"], 50, 100, 40)
    each = rows.selectExpr("row", "size(pieces) - 1 AS last", "posexplode(pieces) AS (k, piece)")
    told = {r.row: r.n_tokens for r in token_counts.splice(token_counts._beginnings(each, PATH, 100, 40)).collect()}
    of = {r.row: r.kept.doc_id for r in rows.collect()}
    assert {of[k]: n for k, n in told.items()} == {1: expected("one two three " * 20)[1], 2: None}


def test_chunks_hold_the_text():
    text = "".join(map(chr, range(1000)))
    for stride, overlap in ((100, 40), (300, 1), (1, 1), (999, 1), (1000, 40)):
        pieces = token_counts.pieces_of(text, stride, overlap)
        assert token_counts.text_of(pieces, stride) == text and max(map(len, pieces)) <= stride + overlap


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = registry.op11_token_counts(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    rows = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()}
    assert rows == {i: (*expected(t), expected(t)[1] > 512) for i, t in texts.items()}


def test_odd_and_empty_tables(spark, odd, empty):
    rows = {r.doc_id: r for r in token_counts.count_tokens(odd, PATH, ["doc_id", "part"]).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {r.doc_id: expected(r.text)[1] for r in odd.collect()}
    assert rows[6].part == "other"
    assert token_counts.count_tokens(empty, PATH, ["doc_id"]).count() == 0
    twice = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (7, "c " * 40_000, 2), (7, "d e " * 30_000, 3)], "doc_id long, text string, row int")
    got = sorted(tuple(r)[1:] for r in token_counts.count_tokens(twice, PATH, ["doc_id", "row"]).collect())
    assert got == sorted((r.row, *expected(r.text)) for r in twice.collect())


def test_other_files_are_refused(empty):
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
