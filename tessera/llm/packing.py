"""Packing into optimal length buckets and token-budget batches.

A dynamic programme over the global length histogram picks the bucket
boundaries that minimise padding. Texts longer than ``max_len`` are cut into
pieces of at most that length, so the histogram has at most ``max_len`` rows
however large the corpus is, and nothing is dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Workspace, gapless


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least total padding.

    A row of length x in a bucket with boundary y costs y - x. ``lengths`` are
    distinct and ascending. Of equal solutions the one with the smaller
    boundaries wins.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, dtype=np.float64)
    num = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    tot = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64) * size)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (num[j] - num[:j]) - (tot[j] - tot[:j])
            arg[j] = int(np.argmin(cost))
            new[j] = cost[arg[j]]
        best = new
        cuts.append(arg)
    out, j = [], n
    for arg in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
    return sorted(out)


def pack_lengths(docs: DataFrame, buckets: int = 16, max_len: int = 4096, token_budget: int = 65_536, length: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in batches: doc_id, piece, start, length, bucket, bucket_len, batch, place, padding.

    A piece goes to the first bucket whose boundary is not below its length. A
    batch of bucket b has at most ``token_budget // boundary`` rows (one at
    least), numbered by ``place``; all but a bucket's last batch are full.
    ``length`` is the token count of a document, its words unless given.

    Edge cases: a text without words (null too) has one piece of length 0;
    null ids and repeated rows are rows like others; an empty table gives no
    rows; other columns are ignored.
    """
    tokens = word_count(F.col(text)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    slim = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("_n"))
    cut = F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / max_len)).cast("int")
    pieces = slim.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), cut)).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    pieces = Workspace(docs.sparkSession, "pack").stored(pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_len).cast("long"), F.col("_n") - start).alias("length"), F.xxhash64(F.lit(23), "doc_id", "piece").alias("_h")), "lengths")
    histogram = sorted((r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = optimal_boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    bucket, bound = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("length") <= b, F.lit(i)).otherwise(bucket)
        bound = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(bound)
    placed = pieces.withColumn("bucket", bucket).withColumn("bucket_len", bound)
    ranked = gapless(placed, ["bucket"], ["_h", "doc_id", "piece"], "_h", "_i", sum(n for _, n in histogram))
    rows = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    batched = ranked.withColumn("_rows", rows)
    return batched.select("doc_id", "piece", "start", "length", "bucket", "bucket_len", F.expr("_i div _rows").alias("batch"), (F.col("_i") % F.col("_rows")).cast("int").alias("place"), (F.col("bucket_len") - F.col("length")).alias("padding"))


__all__ = ["BLANKS", "optimal_boundaries", "pack_lengths", "word_count"]
