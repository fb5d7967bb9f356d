"""Every name that an operator uses inside itself, as an extra column of its input."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import tessera.llm
from tessera.llm import chat, exact_dedup, langid, mixing, ngram_join, packing, quality, sharding, toxicity, warc

SOURCE = "".join(p.read_text() for p in Path(tessera.llm.__file__).parent.glob("*.py"))
#: Whatever looks like a column's name in the modules, f-strings filled in.
NAMES = sorted(set(re.findall(r'"(_?[a-z]\w{0,14})"', SOURCE)) | {f"_mix_{x}" for x in ("src", "parts", "cdf", "salt", "own", "n", "i", "key")} | set(re.findall(r'"(_[a-z]+)"', SOURCE)))


def crowded(df, *keep):
    return df.select(*keep, *[F.lit(n).alias(n) for n in NAMES if n not in keep])


@pytest.fixture(scope="module")
def docs(edge):
    return crowded(edge, "doc_id", "text", "lang", "source", "n_chars").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return crowded(spark.createDataFrame([(i, i % 2, i % 3) for i in range(120)], "doc_id long, quality int, toxic int"), "doc_id", "quality", "toxic")


def same_columns(docs, out, more=0):
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + more
    for r in out.limit(5).collect():
        assert all(r[n] == n for n in NAMES if n not in ("doc_id", "text", "lang", "source", "n_chars"))


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    if stage == "packing":
        assert out.count() >= docs.count()
    else:
        same_columns(docs, out)


def test_operators(spark, docs, labels, given):
    n = len(given)
    assert {"_gone", "_sha", "_digest", "_found", "_mix_key", "_mix_own", "shard", "_h", "sig"} <= set(NAMES)
    assert langid.identify(docs, langid.fit_profiles(docs)).count() == n
    assert exact_dedup.exact_dedup(docs).count() == n
    assert exact_dedup.exact_dedup(docs, most_broadcast=0).count() == n
    assert ngram_join.ngram_components(docs, rounds=1).count() == n
    assert packing.pack_lengths(docs).count() >= n
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).count() == n
    assert sharding.assign_shards(docs).count() == n
    assert quality.apply_rules(docs, quality.fit_rules(docs, labels)).count() == n
    same_columns(docs, exact_dedup.deduplicated(docs, most_broadcast=0))
    same_columns(docs, ngram_join.one_of_each(docs, most_broadcast=0))
    for most in (0, 1000):
        same_columns(docs, mixing.mix_sources(docs, most_broadcast=most), 3)


def test_shards_are_written_whole(spark, docs, given, tmp_path):
    name = sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(given) and set(back.columns) == {*docs.columns, name}


def test_pages_and_conversations(spark):
    pages = crowded(spark.createDataFrame([(1, "u", "<p>"), (2, None, "<p>"), (None, "v", None)], "page_id long, url string, html string"), "page_id", "url", "html")
    _, records = warc.archive(pages)
    assert records.count() == 3
    turns = crowded(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    assert chat.digests(chat.format_conversations(turns)).count() == 1
