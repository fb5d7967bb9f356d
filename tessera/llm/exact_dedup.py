"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes meets a pattern, so equal
passages give equal chunks. Each distinct chunk moves once, to verify that no
identifier stands for two contents; from then on a document is its recipe, the
ordered list of its chunks' identifiers, and documents are compared by recipe
only. Long documents never move whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace, ascii_lower, fresh, ship
from .tokens import mix

LEAST, MOST, MASK = 1024, 16_384, (1 << 11) - 1
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


@lru_cache(1)
def _gear() -> np.ndarray:
    return (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: after ``LEAST`` bytes at the first match of the rolling hash, or at ``MOST``."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _gear()[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum over the last 32 bytes, each shifted by its age
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint32(k)
        h = h + older
    marks = np.flatnonzero((h >> np.uint32(8)) & np.uint32(MASK) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def verified_seed(docs: DataFrame, text: str = "text", tries: int = 8) -> int:
    """A seed under which no two different chunks have one identifier.

    Identifiers are 128-bit hashes. Every distinct chunk is compared by content:
    pairs (identifier, chunk) are made distinct, then identifiers counted. On a
    clash the next seed is tried. Copies are dropped in each batch and in the
    map-side part of the aggregation, before anything moves.
    """
    for seed in range(tries):

        def cut(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: set[bytes] = set()
                ids, parts, size = [], [], 0
                for value in batch.column(0):
                    for c in chunks(normalise(value.as_py())):
                        if c in seen:
                            continue
                        seen.add(c)
                        ids.append(xxhash.xxh3_128_digest(c, seed))
                        parts.append(c)
                        size += len(c)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], ["id", "chunk"])
                        seen, ids, parts, size = set(), [], [], 0
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], ["id", "chunk"])

        distinct = docs.select(F.col(text).alias("t")).mapInArrow(cut, "id binary, chunk binary").distinct()
        if distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return seed
    raise RuntimeError("chunk identifiers clash under every seed")


def recipes(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, recipe (16 bytes for each chunk, in order) and text_sha256 of each row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, digests = [], []
            for value in batch.column(1):
                data = normalise(value.as_py())
                made.append(b"".join(xxhash.xxh3_128_digest(c, seed) for c in chunks(data)))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "recipe", "text_sha256"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, recipe binary, text_sha256 string")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = 16 << 20, ws: Workspace | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal if identical after lower-casing A-Z. The row with the
    largest id of a group stays. Groups are counted with map-side sums, and only
    groups of two or more are joined back, on their recipe. They are broadcast up
    to ``most_broadcast`` bytes of recipes, so rows of a large group don't move
    at all; above that AQE splits the join where one group holds many rows. The
    recipes and groups stay in the workspace, as the result reads them.

    Edge cases: a null text counts as empty, and empty texts are equal; null ids
    never win against others (in a group with null ids only, keep_id is null and
    all rows are kept); rows that repeat id and text are all kept or all
    dropped, and each counts in group_size; an empty table gives no rows; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    seed = verified_seed(docs, text)
    ws = ws or Workspace(docs.sparkSession, "exact-dedup")
    slim = ws.stored(recipes(docs, seed, doc_id, text), "recipes")
    groups = ws.stored(slim.groupBy(F.col("recipe").alias("_r")).agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "groups")
    size = groups.agg(F.sum(F.octet_length("_r") + 64)).first()[0] or 0
    out = slim.join(F.broadcast(groups) if size <= most_broadcast else groups, F.col("recipe") == F.col("_r"), "left")
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", (F.octet_length("recipe") / 16).cast("int").alias("n_chunks"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, and once each.

    Rows are dropped by (id, digest of the text), so rows that repeat an id with
    another text are judged apart. The dropped list is broadcast up to
    ``most_broadcast`` rows and joined by a shuffle above that. Rows that repeat
    both id and text become one; only if there are such rows are texts moved
    for it. For edge cases see ``exact_dedup``; all columns are kept, whatever
    their names.
    """
    ws = Workspace(docs.sparkSession, "deduplicated")
    result = ws.stored(exact_dedup(docs, doc_id, text, ws=ws).select("doc_id", "text_sha256", "kept"), "dedup")
    gone, sha, key = fresh(docs, "_gone"), fresh(docs, "_sha"), fresh(docs, "_digest")
    dropped = ws.stored(result.where("not kept").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha)).distinct(), "dropped")
    again = not result.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    ws.keep(dropped)
    few = dropped.count() <= most_broadcast
    digest = F.sha2(ascii_lower(docs[text]).cast("binary"), 256)
    left = docs.join(F.broadcast(dropped) if few else dropped, docs[doc_id].eqNullSafe(dropped[gone]) & (digest == dropped[sha]), "left_anti")
    if not again:
        return left
    return left.withColumn(key, F.sha2(ascii_lower(left[text]).cast("binary"), 256)).dropDuplicates([doc_id, key]).drop(key)
