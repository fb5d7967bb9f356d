"""Language identification by rank-order profiles.

A profile is a list of the most frequent character n-grams (1 to 3 letters,
word edges marked), most frequent first. A text gets the language whose profile
is nearest by out-of-place distance: the sum, over the text's own most frequent
n-grams, of how far each is from its rank in the profile; one that the profile
lacks counts as the longest distance.
"""

from __future__ import annotations

import warnings
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, held_out, ship

UNKNOWN = "und"
_BITS, MARK = 21, 1  # bits of a code point; what stands for a word's edge, so that "a" and "a at an edge" differ
PIECE = 1 << 20  # characters taken at a time


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngram_codes(text: str) -> np.ndarray:
    """All n-grams of the text as integers; no letter, no n-grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = np.where(_letters()[points], points, MARK).astype(np.int64)
    x = np.concatenate(([MARK], x, [MARK]))
    x = x[np.concatenate(([True], (x[1:] != MARK) | (x[:-1] != MARK)))]  # one mark between words
    two = (x[:-1] << _BITS) | x[1:]
    three = (two[:-1] << _BITS) | x[2:]
    return np.concatenate((x[x != MARK], two[(x[:-1] != MARK) | (x[1:] != MARK)], three[x[1:-1] != MARK]))


def counted_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, ascending, and how often each occurs.

    A long text is taken in pieces of about ``PIECE`` characters that end between
    words, which has no effect on the counts.
    """
    if len(text) <= PIECE:
        return np.unique(ngram_codes(text), return_counts=True)
    codes, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1
        more, n = np.unique(ngram_codes(text[at:end]), return_counts=True)
        every, spot = np.unique(np.concatenate((codes, more)), return_inverse=True)
        codes, counts, at = every, np.bincount(spot, np.concatenate((counts, n)), len(every)).astype(np.int64), end
    return codes, counts


def top_ngrams(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    codes, counts = counted_ngrams(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """``codes`` holds the n-grams of all profiles, ascending; ``ranks`` (language x code) their ranks."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """From (language, n-gram, rank) rows."""
        langs = sorted({r[0] for r in rows})
        codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        ranks = np.full((len(langs), len(codes)), size, dtype=np.int32)
        for lang, code, rank in rows:
            ranks[langs.index(lang), np.searchsorted(codes, code)] = rank
        return cls(langs, codes, ranks, size)

    def best(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: 1 less the share of the longest distance, and its lead over the second."""
        top = top_ngrams(text, self.size) if text else self.codes[:0]
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        far = np.abs(self.ranks[:, at] - np.arange(len(top)))
        missing = (self.codes[at] != top) | (self.ranks[:, at] == self.size)
        near = 1.0 - np.where(missing, self.size, far).sum(axis=1) / (self.size * len(top))
        k = int(np.argmax(near))
        rest = np.delete(near, k)
        return self.langs[k], float(min(1.0, max(0.0, near[k]))), float(near[k] - rest.max()) if len(rest) else float(near[k])


def fit_profiles(docs: DataFrame, size: int = 300, most_rows: int = 4_000, most_langs: int = 1_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Learn a profile for each language from rows that are not held out.

    The bound of the fit: rows are chosen by a hash of the id so that about
    ``most_rows`` of each language are expected, or all where there are fewer.
    N-grams are counted for each Arrow batch, then summed by Spark; only the
    profiles, ``size`` rows for each language, reach the driver. More than
    ``most_langs`` languages are an error.
    """
    ship(docs.sparkSession)
    usable = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_id")))
    sizes = usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()
    if len(sizes) > most_langs:
        raise ValueError(f"the labels name more than most_langs={most_langs} languages")
    if not sizes:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int32), size)
    share = F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1_000_000)) / 1_000_000
    rates = docs.sparkSession.createDataFrame([(r["_lang"], min(1.0, most_rows / r["n"])) for r in sizes], "_of string, _rate double")
    chosen = usable.join(F.broadcast(rates), F.col("_lang") == F.col("_of")).where(share < F.col("_rate")).select("_lang", "_text")  # most_langs rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            waiting = 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, n = counted_ngrams(t.as_py())
                held.setdefault(k, []).append(np.stack((codes, n)))
                waiting += len(codes)
                if waiting > 200_000:
                    yield from summed(held)
                    held, waiting = {}, 0
            yield from summed(held)

    def summed(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, found in held.items():
            both = np.concatenate(found, axis=1)
            codes, spot = np.unique(both[0], return_inverse=True)
            n = np.bincount(spot, both[1], len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counts = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the limit is pushed below the exchange: each task sends its first rows of a language only
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    return Profiles.of([tuple(r) for r in ranked.select("lang", "code", F.col("rank") - 1).collect()], size)


def predict(text: Column, profiles: Profiles) -> Column:
    """A struct (lang, score, margin) for each text, from the text alone."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double,margin:double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [profiles.best(x.as_py()) for x in texts]
        return pa.array([dict(zip(("lang", "score", "margin"), f, strict=True)) for f in found], kind)

    return run(text)


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, margin.

    Edge cases: a null text, or one without letters, is ``und`` with score 0, as
    is every text if no language was learned; of languages at equal distance the
    first by name wins; null ids are held out; repeated rows get equal results;
    an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), predict(F.col(text), profiles).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.margin").alias("margin"))


def in_languages(docs: DataFrame, profiles: Profiles, wanted: Collection[str] | None = None, least_score: float = 0.25, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a wanted language (any that was learned if None), with all their columns.

    A text goes if its nearest profile is of another language, or scores below
    ``least_score``: it is in none of the languages then, as are texts without
    letters. If no language was learned nothing can be told, so all rows stay
    and a warning is given.

    Edge cases: as in ``identify``; null and empty texts go; repeated rows are
    judged alike; columns keep their names, whatever they are.
    """
    if not profiles.langs:
        warnings.warn("no language was learned, so no document is rejected", stacklevel=2)
        return docs
    ship(docs.sparkSession)
    name = fresh(docs, "_found")
    marked = docs.withColumn(name, predict(docs[text], profiles))
    good = F.col(f"{name}.lang") != UNKNOWN if wanted is None else F.col(f"{name}.lang").isin(sorted(wanted))
    return marked.where(good & (F.col(f"{name}.score") >= least_score)).drop(name)
