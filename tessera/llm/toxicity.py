"""Toxic passages as maximum-scoring segments of token log-odds.

Each token scores its log-odds of toxic against clean documents under a
Dirichlet prior, whichever sign they have, less a drift that makes ordinary text
score below zero. A token that does not differ between the two kinds beyond
chance (or is unknown) has log-odds 0, so it scores minus the drift. A linear-time
scan finds all maximal scoring segments of a text. A segment's significance
follows from the extreme-value law of such maxima (Karlin and Altschul): in
clean text of n tokens the number of segments scoring S or more is about
K n exp(-lambda S). The evidence of the significant segments is mapped to a
probability by a logistic curve fitted on other labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, held_out, ship
from .quality import labelled_sample

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence.

    ``hits`` are (position, score) of the tokens with a score of their own, of
    either sign; all others score -drift and are passed over in one step. Each
    candidate remembers the nearest one before it that begins at a lower running
    sum, so looking back never passes one twice.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []
    gained = 0.0
    for at, score in hits:
        if score <= 0:
            gained += score + drift
            continue
        a = z = at
        l = gained - drift * at  # noqa: E741
        r = l + score
        gained += score + drift
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= l:
                j = back[j]
            if j < 0 or high[j] >= r:
                first.append(a)
                last.append(z)
                low.append(l)
                high.append(r)
                back.append(j)
                break
            a, l = first[j], low[j]  # noqa: E741
            for x in (first, last, low, high, back):
                del x[j:]
    return [(a, z, h - l) for a, z, l, h in zip(first, last, low, high, strict=True)]


@dataclass
class Model:
    """Scores of the known tokens (log-odds less drift), the drift, the extreme-value law and the logistic curve."""

    scores: dict[str, float]
    drift: float = 1.0
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = -3.0
    significant: float = 0.05

    def p_value(self, score: float, length: int) -> float:
        """The chance that clean text of this length has a segment scoring so high."""
        return -math.expm1(-self.k * length * math.exp(-min(700.0, self.lam * score)))

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """Significant segments (first token, last token, score, p-value) and the number of tokens."""
        words = tokens(text)
        scores = self.scores
        hits = [(i, scores[w]) for i, w in enumerate(words) if w in scores]
        found = [(a, z, s, self.p_value(s, len(words))) for a, z, s in maximal_segments(hits, self.drift)]
        return [x for x in found if x[3] < self.significant], len(words)

    def evidence(self, found: list) -> float:
        return sum(-math.log(max(x[3], 1e-300)) for x in found)

    def probability(self, evidence: float) -> float:
        x = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def log_odds(toxic: Column, clean: Column, all_toxic: int, all_clean: int, prior: float) -> tuple[Column, Column]:
    """Log-odds of a token under a Dirichlet prior in proportion to its overall frequency, and its G statistic."""
    both, total = toxic + clean, all_toxic + all_clean
    alpha = prior * both / total
    odds = lambda y, n: F.log((y + alpha) / (n + prior - y - alpha))
    part = lambda y, n: F.when(y > 0, y * F.log(y / (n * both / total))).otherwise(0.0)
    return odds(toxic, all_toxic) - odds(clean, all_clean), 2 * (part(toxic, all_toxic) + part(clean, all_clean))


def solve_lambda(background: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1; ``background`` has (score, share) of the known tokens, the others score -drift."""
    score, share = np.array([s for s, _ in background]), np.array([p for _, p in background])
    rest = max(0.0, 1 - share.sum())
    f = lambda x: rest * math.exp(-drift * x) + float((share * np.exp(np.minimum(700.0, score * x))).sum()) - 1
    low, high = 1e-3, 1e-3
    while f(high) < 0 and high < 50:
        high *= 1.5
    if high >= 50:
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a regularised logistic fit with smoothed labels (Platt)."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(2)
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (t - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 20_000, prior: float = 50.0, drift: float = 1.0, least_g: float = 10.83, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``most_rows`` labelled documents that are not held out.

    They are read once and kept in a table while this runs. Two thirds of them
    give the token scores, one third the extreme-value law and the logistic
    curve. A token's count is the number of documents that have it; counts are
    summed in each batch, then by Spark. All tokens with a G of ``least_g`` or
    more reach the driver; the sample bounds their number.
    """
    ship(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "toxicity")
    rows = ws.stored(labelled_sample(docs, labels, label, most_rows, doc_id, text), "sample")
    third = F.pmod(F.xxhash64(F.lit(29), "_id"), F.lit(3)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part, by = batch.slice(at, 1000), (Counter(), Counter())
                for y, t in zip(part.column(0), part.column(1), strict=True):
                    by[y.as_py() > 0].update(set(tokens(t.as_py())))
                every = list(by[0].keys() | by[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([by[1][w] for w in every], pa.int64()), pa.array([by[0][w] for w in every], pa.int64())], ["token", "toxic", "clean"])

    counts = ws.stored(rows.where(~third).select("_label", "_t").mapInArrow(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "counts")
    totals = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n_toxic, n_clean = totals[0] or 0, totals[1] or 0
    model = Model({}, drift)
    if n_toxic and n_clean:
        odds, g = log_odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean, prior)
        known = counts.select("token", "clean", odds.alias("odds"), g.alias("g")).where(F.col("g") >= least_g).orderBy("token").collect()
        model.scores = {r["token"]: r["odds"] - drift for r in known}
        model.lam = solve_lambda([(r["odds"] - drift, (r["clean"] + 0.5) / (n_clean + 1)) for r in known], drift)
        _calibrate(model, rows.where(third).select((F.col("_label") > 0).alias("toxic"), "_t"))
    else:
        model.offset = 10.0 if n_toxic else -10.0
    ws.keep()
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Set K from the segments of clean rows, then the logistic curve from the evidence of all; texts stay where they are."""
    least = min((s for s in model.scores.values() if s > 0), default=None)
    if least is None:
        return

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, over = [], []
            for t in batch.column(1):
                words = tokens(t.as_py())
                length.append(len(words))
                hits = [(i, model.scores[w]) for i, w in enumerate(words) if w in model.scores]
                over.append(sum(s >= least for _, _, s in maximal_segments(hits, model.drift)))
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(over, pa.int64())], ["n", "over"])

    room, seen = rows.where("not toxic").mapInArrow(scan, "n long, over long").agg(F.sum("n"), F.sum("over")).first()
    model.k = ((seen or 0) + 0.5) / max(1.0, (room or 0) * math.exp(-model.lam * least))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.evidence(model.segments(t.as_py())[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["toxic", "evidence"])

    held = sorted(tuple(r) for r in rows.mapInArrow(weigh, "toxic boolean, evidence double").collect())  # a third of most_rows
    y, x = np.array([r[0] for r in held], dtype=float), np.array([r[1] for r in held])
    if len(y) and 0 < y.sum() < len(y):
        model.slope, model.offset = logistic(x, y)


def scored(text: Column, model: Model) -> Column:
    """A struct (score, segments) for each text; a segment has its first and last character, score and p-value."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("segments", pa.list_(span))])

    @F.arrow_udf("struct<score:double,segments:array<struct<start:int,end:int,score:double,p:double>>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            t = value.as_py()
            found, _ = model.segments(t)
            spots = [m.span() for m in TOKEN.finditer(t.lower())] if found else []
            out.append({"score": model.probability(model.evidence(found)), "segments": [{"start": spots[a][0], "end": spots[z][1], "score": s, "p": p} for a, z, s, p in found]})
        return pa.array(out, kind)

    return run(text)


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, segments.

    Edge cases: null and empty texts have no segments and get the score of no
    evidence; without labels of both kinds every text gets one score; null ids
    are held out; repeated rows get equal results; an empty table gives no rows;
    other columns are ignored. Segment offsets are characters of the lower-cased text.
    """
    ship(docs.sparkSession)
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), scored(F.col(text), model).alias("s"))
    return found.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.segments").alias("segments"))
