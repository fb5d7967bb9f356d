"""Sharding by histogram sort: exact byte counts, refined probes, one exchange.

Native: DataFrame expressions only. Rows are ordered by (hash of the text, hash
of the id). Each round counts the exact bytes between candidate key boundaries
in one aggregation, with at most ``probes`` buckets for each splitter, and
narrows every splitter's interval to the bucket that holds its target. Equal
texts share a key, so they stay in one shard unless their group is too large
for the tolerance: then the group itself is cut, by the hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, gapless

TOP = (1 << 63) - 1


def text_key(text: Column) -> Column:
    """A position of the text in the key space 0 to 2**63-1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(11), F.coalesce(text, F.lit(""))), 1)


def row_key(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(13), doc_id), 1)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; a null text has no bytes."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def find_splitters(slim: DataFrame, shards: int, tolerance: float = 0.005, probes: int = 64, copies: str = "cut") -> tuple[list[tuple[int, int]], int]:
    """Boundaries (text key, row key) of the shards over ``slim`` (k, r, size), and the number of rows.

    A row belongs to the first shard whose boundary is above it. Each boundary
    is within ``tolerance`` times the mean shard's bytes of its target, or is
    the nearest one between two rows (between two texts if ``copies`` is
    ``whole``). Only bucket counts reach the driver, at
    most ``probes`` for each open splitter.
    """
    total, rows = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    if not total or shards < 2:
        return [], rows
    near = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    # shard -> (key that is being cut or None, low, high, bytes below low)
    seek = {j: (None, 0, TOP, 0) for j in range(1, shards)}
    while seek:
        counted: dict[tuple, list] = {v[:3]: [] for v in seek.values()}
        # spans of one kind are equal or apart, but a span of text keys can hold a key that is being cut
        for name in ("k", "r"):
            spans = [s for s in counted if (s[0] is None) == (name == "k")]
            if not spans:
                continue
            tag, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
            for i, (cut, lo, hi) in enumerate(spans):
                inside = F.col(name).between(lo, hi) & (F.lit(True) if cut is None else F.col("k") == cut)
                tag = F.when(inside, F.lit(i)).otherwise(tag)
                slot = F.when(inside, F.expr(f"({name} - {lo}L) div {(hi - lo) // probes + 1}L")).otherwise(slot)
            found = slim.select(tag.alias("tag"), slot.alias("slot"), F.col(name).alias("v"), "size").where("tag is not null")
            for x in found.groupBy("tag", "slot").agg(F.sum("size").alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                counted[spans[x["tag"]]].append((x["lo"], x["hi"], x["b"]))
        for j, (cut, lo, hi, below) in list(seek.items()):
            goal = total * j / shards
            at = lambda v, cut=cut: (v, 0) if cut is None else (cut, v)
            for first, last, size in sorted(counted[cut, lo, hi]):
                if below + size <= goal:
                    below += size
                    continue
                if goal - below <= near:
                    done[j] = at(first)
                elif below + size - goal <= near:
                    done[j] = at(last + 1)
                elif first < last:
                    seek[j] = (cut, first, last, below)
                elif cut is None and copies == "cut":
                    seek[j] = (first, 0, TOP, below)
                else:  # one text, one row, or rows with one id: the nearer side
                    done[j] = at(first) if goal - below <= below + size - goal else at(last + 1)
                break
            else:
                done[j] = at(hi + 1)
            if j in done:
                del seek[j]
    return [done[j] for j in range(1, shards)], rows


def shard_of(splitters: list[tuple[int, int]], k: Column, r: Column) -> Column:
    out = F.lit(0)
    for j, (a, b) in enumerate(splitters, 1):
        at_least = F.lit(False) if a > TOP else k > a if b > TOP else (k > a) | ((k == a) & (r >= b))
        out = F.when(at_least, F.lit(j)).otherwise(out)
    return out


def cut_keys(slim: DataFrame, splitters: list[tuple[int, int]]) -> list[int]:
    """The text keys of which some rows lie below a boundary and others above it: fewer than there are shards."""
    inside = sorted({(a, b) for a, b in splitters if 0 < b and a <= TOP})
    if not inside:
        return []
    spans = {r["k"]: (r["lo"], r["hi"]) for r in slim.where(F.col("k").isin(sorted({a for a, _ in inside}))).groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    return sorted({a for a, b in inside if a in spans and spans[a][0] < b <= spans[a][1]})


def assign_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, copies: str = "cut", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_cut.

    The law is ``bytes``: the shards' sizes are near equal. ``slot`` numbers the
    rows of a shard from 0 without gaps; ``grown_shard`` is null under this law.
    Equal texts lie side by side. ``copies`` tells what happens to a group of
    them that is too large for the tolerance: ``cut`` divides it by rows, so the
    law holds whatever the groups; ``whole`` never divides one, so a shard may be
    larger by a group. ``group_cut`` marks the rows of texts that were divided.
    The rows move in one exchange, by (shard, part of the shard), so neither a
    shard nor a group of copies has to fit one task.

    Edge cases: a null text has size 1 and counts as equal to an empty one; null
    ids share one row key; rows that repeat both id and text cannot be told
    apart and stay together; an empty table gives no rows; other columns are
    ignored.
    """
    if copies not in ("cut", "whole"):
        raise ValueError(f"copies must be cut or whole, not {copies!r}")
    t = F.col(text)
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), text_size(t).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(t).alias("k"), row_key(F.col(doc_id)).alias("r"),
    )
    slim = Workspace(docs.sparkSession, "shards").stored(keyed, "keys")
    splitters, rows = find_splitters(slim.select("k", "r", "size"), shards, tolerance, copies=copies)
    cut = cut_keys(slim, splitters)
    placed = slim.withColumn("shard", shard_of(splitters, F.col("k"), F.col("r"))).withColumn("group_cut", F.col("k").isin(cut) if cut else F.lit(False))
    slotted = gapless(placed, ["shard"], ["k", "r", "text_crc32"], "r", "slot", rows)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_cut")


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.005, copies: str = "cut", doc_id: str = "doc_id", text: str = "text") -> str:
    """Write ``docs`` as Parquet below ``path``, one folder for each shard; returns the folders' column.

    That column is ``shard``, with underscores added if ``docs`` has the name
    already, so all columns are kept.

    Edge cases: as in ``assign_shards``; an empty table writes no shard.
    """
    ws, name, deal = Workspace(docs.sparkSession, "shards"), fresh(docs, "shard"), fresh(docs, "_deal")
    k, r = text_key(F.col(text)), row_key(F.col(doc_id))
    splitters, _ = find_splitters(ws.stored(docs.select(text_size(F.col(text)).alias("size"), k.alias("k"), r.alias("r")), "keys"), shards, tolerance, copies=copies)
    ws.keep()
    dealt = docs.withColumns({name: shard_of(splitters, k, r), deal: F.pmod(r, F.lit(64))})
    dealt.repartition(F.col(name), F.col(deal)).drop(deal).write.partitionBy(name).parquet(path)
    return name
