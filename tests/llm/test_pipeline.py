"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

import sys
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same  # noqa: E402

import corpus_pipeline  # noqa: E402
from hexweave.llm import minhash, registry  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, documents):
    docs = documents
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, SF))
        assert out.columns == documents.columns
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before if name == "language_id" else after < before
        if name == "quality_rules":
            assert all(len(brute.SPACE.findall(texts[i] or "")) >= 20 for i in after)
        if name == "near_duplicates":
            part = brute.near_documents([(i, texts[i]) for i in before], percent=corpus_pipeline.NEAR_PERCENT)
            assert after == {i for i, (_, c) in part.items() if i == c}
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == after
    brute.check_places(rows)
    assert {tuple(r)[:5] for r in rows} == {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()}


def test_clean_documents_stay(spark, documents, labels):
    good = labels.filter("quality = 1").select("doc_id").join(documents, "doc_id")
    kept = corpus_pipeline.quality_stage(spark, documents, SF).select("doc_id")
    n, m = good.count(), good.join(kept, "doc_id", "left_semi").count()
    assert m >= 0.95 * n


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, documents, stage):
    """Rows of nulls do not change what becomes of the others; without a text a row goes, but is no near-duplicate and is a piece."""
    some = documents.orderBy("doc_id").limit(40)
    odd = documents.orderBy(F.desc("doc_id")).limit(3).select([F.lit(None).cast(t).alias(c) if c != "doc_id" else F.col(c) for c, t in documents.dtypes])
    both = some.unionByName(odd).withColumn("part", F.lit("x"))
    out, name = stage(spark, both, SF), stage.__name__
    ids, bare = sorted(r.doc_id for r in out.collect()), sorted(r.doc_id for r in odd.collect())
    assert ids == sorted([*(r.doc_id for r in stage(spark, some, SF).collect()), *(bare if name in ("near_duplicate_stage", "packing_stage") else [])])
    assert out.columns == (both.columns if name != "packing_stage" else ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    assert stage(spark, both.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:2]], ids=[n for n, _ in corpus_pipeline.STAGES[:2]])
def test_clashing_names_null_and_repeated_ids(spark, documents, stage):
    """The same rows stay whatever other columns are called; each row is judged by itself."""
    docs = documents.limit(60)
    names = ["kept", "n_words", "p_quality", "lang_pred", "lang_score", "Judged", "told", "row", "part"]
    odd = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    model_rows = {r.doc_id for r in stage(spark, docs, SF).collect()}
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == model_rows
    assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in out.collect())
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")))
    kept = [r.doc_id for r in stage(spark, twice, SF).collect()]
    assert len([i for i in kept if i is None]) * 2 == len([i for i in kept if i is not None])
    assert all(kept.count(i) == 2 for i in set(kept) - {None})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert_same(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_names():
    assert sorted(n.split("_")[0] for n in registry.queries()) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])


def test_near_duplicate_threshold(spark):
    """Copies between 0.80 and 0.85 go too, and less similar ones stay."""
    words = [f"w{i}" for i in range(100)]
    changed = [" ".join("x" if i in at else w for i, w in enumerate(words)) for at in ([], [20, 60], [10, 30, 50, 70])]
    rows = list(enumerate(changed, 1))
    assert brute.near_documents(rows)[2][1] == 2, "below op7's own threshold"
    part = brute.near_documents(rows, percent=80)
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in part.items() if i == c} == {1, 3}


def test_near_duplicate_stage_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    part = brute.near_documents(rows, percent=80)
    out = corpus_pipeline.near_duplicate_stage(spark, documents, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, (_, c) in part.items() if i == c}


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_band_layout(percent):
    rows, bands = minhash.layout(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    assert minhash.layout(85) == (7, 28)


def test_null_and_repeated_ids(spark):
    """Rows with a null id stay, of exact repeats one row stays, and another text under the same id is another document."""
    said = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(5)]
    near = said[0].replace("t0w30", "other")
    rows = [(None, said[3]), (None, said[4]), (None, said[3]), (7, said[0]), (7, said[0]), (7, said[1]), (9, said[2]), (3, near), (9, said[2]), (8, near)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, row_0 int").repartition(3)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(None, said[3]), (None, said[3]), (None, said[4]), (3, near), (7, said[1]), (9, said[2])], key=str)


def test_odd_rows_keep_their_ids(spark, documents):
    """The kept ids of a table with nulls in each column, doc_id too."""
    some = documents.limit(40)
    odd = documents.orderBy(F.desc("doc_id")).limit(3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    both = some.unionByName(odd).unionByName(some.limit(5))
    part = brute.near_documents([(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()], percent=80)
    got = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, both, SF).select("doc_id").collect()]
    assert got.count(None) == 3 and sorted(i for i in got if i is not None) == sorted(i for i, (n, c) in part.items() if i == c)
