import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from oracle import DATA
from tessera.llm import langid, queries


def test_ngrams():
    decode = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)).lstrip("\0").replace("\1", "_")
    found = sorted(decode(c) for c in langid.ngram_codes("Ab, a!").tolist())
    assert found == sorted(["a", "b", "a", "_a", "ab", "b_", "_a", "a_", "_ab", "ab_", "_a_"])
    assert not len(langid.ngram_codes("12 ?!")) and not len(langid.ngram_codes(""))


def test_out_of_place_distance():
    profiles = langid.Profiles.of([("x", 97, 0), ("x", 98, 1), ("y", 98, 0)], 3)
    assert profiles.ranks.tolist() == [[0, 1], [3, 0]]
    assert profiles.best(None) == profiles.best("77") == ("und", 0.0, 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.identify(docs, langid.fit_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_predictions_by_brute_force(spark):
    """Profiles and distances of the query, counted plainly."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()

    def grams(text):
        marked = " " + " ".join(regex.findall(r"\w+", "".join(c if c.isalpha() else " " for c in (text or "").lower()))) + " "
        found = Counter()
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if (n == 1 and g != " ") or (n == 2 and g != "  ") or (n == 3 and g[1] != " "):
                    found[g] += 1
        return found

    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
    first = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:300]]
    each = {r["doc_id"]: grams(r["text"]) for r in rows}
    total = {}
    for r in rows:
        if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            total.setdefault(r["lang"], Counter()).update(each[r["doc_id"]])
    ranks = {k: {g: i for i, g in enumerate(first(c))} for k, c in total.items()}
    found = {r["doc_id"]: r for r in queries.op1_rank_order_profiles(spark, DATA).collect()}
    assert len(found) == len(rows)
    for i, counts in each.items():
        top = first(counts)
        far = {k: sum(abs(p[g] - n) if g in p else 300 for n, g in enumerate(top)) for k, p in sorted(ranks.items())}
        best = min(far, key=far.get) if top else "und"
        assert found[i]["lang_pred"] == best and abs(found[i]["score"] - (1 - far[best] / (300 * len(top)) if top else 0)) < 1e-9


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "ein Wort, noch ein W\u00f6rtchen; 12 und " * 300 + "x" * 900 + " Ende"
    whole = langid.counted_ngrams(text)
    monkeypatch.setattr(langid, "PIECE", 100)
    parts = langid.counted_ngrams(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_too_many_languages_are_an_error(edge):
    with pytest.raises(ValueError, match="most_langs=1"):
        langid.fit_profiles(edge, most_langs=1)


def test_edges(edge, nothing, given):
    profiles = langid.fit_profiles(edge)
    found = langid.identify(edge, profiles).collect()
    assert len(found) == len(given)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 5)) and by[6]["lang_pred"] in {"de", "en", "es", "fr"}
    assert all(r["held_out"] for r in found if r["doc_id"] is None)
    assert langid.identify(nothing, profiles).count() == 0
    empty = langid.fit_profiles(nothing)
    assert empty.langs == [] and {r["lang_pred"] for r in langid.identify(edge, empty).collect()} == {"und"}


def test_bound_of_the_fit(edge):
    small = langid.fit_profiles(edge, size=20, most_rows=5)
    assert small.ranks.shape[0] <= 4 and (small.ranks < 20).sum(axis=1).max() <= 20


@pytest.mark.parametrize("text", ["the", "a" * 5000, "\ud800"])
def test_odd_texts(text):
    langid.top_ngrams(text, 5)
