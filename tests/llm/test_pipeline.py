from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import FOLD, components
from oracle import DATA
from tessera.llm import langid, ngram_join
from tessera.llm.common import shared_dir


def test_stages(spark, edge):
    """Each stage takes effect on what the one before kept, and keeps the columns."""
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars").cache()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    step = dict(corpus_pipeline.STAGES)
    one = step["language_id"](spark, docs, "").cache()
    assert one.columns == docs.columns
    profiles = langid.fit_profiles(docs)
    far = {r["text"] for r in docs.collect() if profiles.best(r["text"])[1] < 0.25}
    assert far >= {None, "", "42 17 --- %%%"} and len(far) < 15
    letters = [r for r in docs.collect() if r["text"] not in far]
    assert sorted(one.collect(), key=repr) == sorted(letters, key=repr)
    two = step["exact_dedup"](spark, one, "").cache()
    assert two.columns == docs.columns and two.count() == len({r["text"].translate(FOLD) for r in letters})
    three = step["ngram_join"](spark, two, "").cache()
    kept = {i for i, _, c in components([(r["doc_id"], r["text"]) for r in two.collect() if r["doc_id"] is not None], 5, 80, 100) if i == c}
    assert {r["doc_id"] for r in three.collect()} == kept | {r["doc_id"] for r in two.where("doc_id is null").collect()}
    four = step["mixing"](spark, three, "").cache()
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= {r["doc_id"] for r in three.collect()}
    five = step["packing"](spark, four, "")
    assert five.where("piece = 0").count() == four.count()
    assert langid.UNKNOWN == "und"


def test_language_stage_keeps_learned_languages_only(spark):
    """Two languages of their own letters; a third that no label names, noise, and a corpus without labels."""
    docs = [(i, "the cat sat on the mat with that hat", "en") for i in range(20)] + [(20 + i, "\u03b7 \u03b3\u03ac\u03c4\u03b1 \u03ba\u03ac\u03b8\u03b5\u03c4\u03b1\u03b9 \u03b5\u03b4\u03ce", "el") for i in range(20)]
    docs += [(50, "\u043a\u043e\u0442 \u0441\u0438\u0434\u0438\u0442 \u043d\u0430 \u043a\u043e\u0432\u0440\u0435", None), (51, "12 34 --", None), (52, None, "en"), (53, "that cat sat", None)]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()}
    assert kept == set(range(40)) | {53}
    profiles = langid.fit_profiles(df)
    assert {r["doc_id"] for r in langid.in_languages(df, profiles, wanted=["en"]).collect()} == set(range(20)) | {53}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    with pytest.warns(UserWarning, match="no language"):
        assert corpus_pipeline.language_id(spark, unlabelled, "").count() == len(docs)


def test_empty_table(spark, nothing):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out


def shared_files(spark):
    top = Path(shared_dir(spark).removeprefix("file:"))
    return {f for f in top.rglob("*.parquet")}


def test_calls_leave_only_their_result(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = shared_files(spark)
    near = ngram_join.one_of_each(docs)
    new = {f.parent.name.split("-", 1)[1] for f in shared_files(spark) - before}
    assert new == {"near"} and near.count() < docs.count()
    before = shared_files(spark)
    out = corpus_pipeline.run(spark, DATA)
    kept = {f.parent.name.split("-", 1)[1] for f in shared_files(spark) - before}
    assert kept <= {"packing", "near", "dropped", "rates", "lengths"} and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
