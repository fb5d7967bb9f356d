"""N-gram Jaccard self-join by PartEnum signatures.

Sets are put in bands of near equal size. For two sets of one family of bands
the Jaccard bound gives a bound k on the size of their symmetric difference. The
feature domain is hashed into n1 first-level parts of n2 cells each; if two sets
differ in at most k features, some first-level part differs in at most k2 of
them, so n2 - k2 of its cells agree in full. A signature is the hash of a set's
features in one such subset of cells; all subsets are enumerated, so two sets
that are similar enough share a signature for certain. Sharing is exact; every
candidate is then verified on the sets themselves.

Empty subsets would bring unrelated sets together. They are never emitted:
spare first-level parts make up for the poor ones (with too few filled cells).
How many a set can spare follows from its own size, which bounds its difference
from any similar set more tightly than k does. A set with more poor parts than
that also emits signatures under the next seed. Two sets meet under the smaller
of their last seeds, where one of them has enough good parts. A set that is still poor under the
last seed (a tiny one) adds a signature for each feature of its prefix in hash
order; two such sets that are similar enough share one of these.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh, ship
from .exact_dedup import normalise
from .tokens import mix, shingle_set, word_hashes

_G = np.uint64(0x9E3779B97F4A7C15)
SKETCH, SEEDS = 1024, 8
#: Kinds of signature rows: met once in its part of a batch, first of several, one of the others; and a row with a set's size and sketch.
ALONE, SEVERAL, FOLLOWER, SIZE = 0, 1, 2, 3


@dataclass(frozen=True)
class Scheme:
    """The partitions of one family: bound on the difference, parts, cells of a part, cells that may differ."""

    k: int
    n1: int
    n2: int
    k2: int


class PartEnum:
    """Bands and schemes for Jaccard >= num / den."""

    def __init__(self, num: int, den: int, cells: int = 3):
        self.num, self.den, self.cells = num, den, cells
        self._bands: list[tuple[int, int]] = []

    def __eq__(self, other: object) -> bool:
        return isinstance(other, PartEnum) and (self.num, self.den, self.cells) == (other.num, other.den, other.cells)

    def __hash__(self) -> int:
        """Equal for equal parameters: what one task of a worker has cached serves the next."""
        return hash((self.num, self.den, self.cells))

    def bands(self, size: int) -> list[tuple[int, int]]:
        while not self._bands or self._bands[-1][1] < size:
            low = self._bands[-1][1] + 1 if self._bands else 1
            self._bands.append((low, low * self.den // self.num))
        return self._bands

    def families(self, size: int) -> tuple[int, int]:
        """A set's own band and the next: a family holds the sets of its band and of the one below."""
        b = next(i for i, (_, high) in enumerate(self.bands(size)) if size <= high)
        self.bands(self._bands[b][1] + 1)
        return b, b + 1

    @lru_cache(4096)  # noqa: B019
    def scheme(self, family: int) -> Scheme:
        high = self._bands[family][1]
        k = (self.den - self.num) * 2 * high // (self.den + self.num)
        if k == 0:
            return Scheme(0, 1, 1, 0)
        k2, n2 = 1, self.cells
        base, spare = -(-(k + 1) // (k2 + 1)), 0
        low = self._bands[max(0, family - 1)][0]
        sizes = sorted({low + (high - low) * i // 8 for i in range(9)})

        def enough(n1: int) -> bool:
            """Whether sets of all sizes of the family will have few poor parts, by three standard deviations."""
            for size in sizes:
                empty = math.exp(-size / (n1 * n2))
                poor = n1 * sum(math.comb(n2, f) * (1 - empty) ** f * empty ** (n2 - f) for f in range(k2 + 1))
                if n1 - 1 - self.reach(size, k) // (k2 + 1) < poor + 3 * math.sqrt(poor):
                    return False
            return True

        while spare < base and not enough(base + spare):
            spare += 1
        return Scheme(k, base + spare, n2, k2)

    def reach(self, size: int, k: int) -> int:
        """The largest symmetric difference that a set of this size can have with any similar one."""
        return min(k, (self.den - self.num) * size // self.num)

    @lru_cache(8192)  # noqa: B019
    def _salts(self, family: int, seed: int) -> tuple[np.ndarray, list[list[int]]]:
        s = self.scheme(family)
        subsets = [list(c) for c in itertools.combinations(range(s.n2), s.n2 - s.k2)]
        i = np.arange(s.n1 * len(subsets), dtype=np.uint64).reshape(s.n1, len(subsets))
        return mix(i * _G + np.uint64((family << 20) + (seed << 50) + 1)), subsets

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """All signatures of a set of distinct 64-bit features."""
        if not len(features):
            return np.zeros(0, np.uint64)
        value, out = mix(features * _G + np.uint64(5)), []
        for family in self.families(len(features)):
            s = self.scheme(family)
            spare = s.n1 - 1 - self.reach(len(features), s.k) // (s.k2 + 1)
            for seed in range(SEEDS):
                cells = s.n1 * s.n2
                cell = ((mix(features + np.uint64((seed + 1) * int(_G) & (1 << 64) - 1)) >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)
                sums = np.zeros(cells, dtype=np.uint64)
                np.add.at(sums, cell, value)
                filled = np.bincount(cell, minlength=cells).reshape(s.n1, s.n2) > 0
                sums = sums.reshape(s.n1, s.n2)
                salts, subsets = self._salts(family, seed)
                total = np.stack([sums[:, c].sum(axis=1) for c in subsets], axis=1)
                used = np.stack([filled[:, c].any(axis=1) for c in subsets], axis=1)
                out.append(mix(total + salts)[used])
                if (filled.sum(axis=1) <= s.k2).sum() <= spare:
                    break
            else:
                prefix = len(features) - -(-self.num * len(features) // self.den) + 1
                out.append(mix(features[:prefix] + np.uint64((family << 8) + 255)))
        return np.concatenate(out)


def _parities(hashes: np.ndarray, width: int) -> np.ndarray:
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of ``SKETCH`` cells as longs: sets that differ in d features have sketches that differ in d bits at most.

    A set of more than ``SKETCH`` features adds the parities of twice as many
    cells as it has features, rounded up to a power of two.
    """
    hashes = mix(features + np.uint64(99))
    base = _parities(hashes, SKETCH)
    if len(features) <= SKETCH:
        return base
    return np.concatenate([base, _parities(hashes, 1 << (2 * len(features) - 1).bit_length())])


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    return [shingle_set(w, n) for w in word_hashes(texts)]


def word_hash(data: bytes) -> bytes:
    """A 128-bit hash of the words of a text that is lower-cased already."""
    return xxhash.xxh3_128_digest(b" ".join(data.split()))


def text_classes(docs: DataFrame) -> DataFrame:
    """The rows (id, t) of ``docs`` with ``h``, the hash of their words."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([word_hash(normalise(t.as_py())) for t in texts], pa.binary())

    return docs.withColumn("h", run("t"))


def _representatives(docs: DataFrame, slim: DataFrame, ws: Workspace, most_broadcast: int) -> tuple[DataFrame, bool]:
    """The rows (id, t) of ``docs`` that stand for their classes, and whether ids are repeated.

    Only ids and hashes are grouped. The rows that go are those with an id that
    is not their class's smallest; their ids are broadcast up to ``most_broadcast``
    and texts are moved only above that. Where ids are repeated, rows are told
    apart by id and hash and written to a table, one for each such pair. Rows
    without an id stay; they give their class a size and nothing else.
    """
    several = slim.groupBy(F.col("h").alias("_k")).agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    grouped = slim.join(several, F.col("h") == F.col("_k")).where("id <> _first")
    copies = ws.stored(grouped.select(F.col("id").alias("_i"), "_k").distinct(), "copies")
    repeated = not slim.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    few = copies.count() <= most_broadcast
    gone = F.broadcast(copies) if few else copies
    if not repeated:
        return docs.join(gone, F.col("id") == F.col("_i"), "left_anti"), False
    left = text_classes(docs).join(gone, (F.col("id") == F.col("_i")) & (F.col("h") == F.col("_k")), "left_anti")
    return ws.stored(left.dropDuplicates(["id", "h"]).select("id", "t"), "firsts"), True


def _signed(classes: DataFrame, scheme: PartEnum, n: int) -> DataFrame:
    """(sig, id) for signatures of two texts or more; with a null sig (id, h, n, s): the size and sketch of each class's set.

    ``classes`` has id and t (text); a row without an id gives a size only.

    Rows of one signature in one part of an Arrow batch are combined before the
    exchange: the first stands for the others, which are known to share it and
    need not meet the rest, so they are dealt by their own id.

    What a part sends to one partition is one row with arrays of signatures and
    ids, in the order of the ids' texts: without a row's frame for each
    signature and with ids that repeat, the exchange holds little more than the
    signatures. Windows over the partition's number need no second exchange.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["to", "kind", "sigs", "ids", "h", "s"]
    narrow = np.uint16 if 3 * parts < 1 << 16 else np.int64  # short keys are sorted by digits

    def dealt(key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts, sizes, sketches, hashes, at = batch.column(1), [], [], [], 0
            while at < len(ids):  # a few MB of text at a time
                part: list[bytes] = []
                size, end = 0, at
                while end < len(ids) and size < 2 << 20:
                    part.append(normalise(texts[end].as_py()))
                    size += len(part[-1])
                    end += 1
                sigs = []
                hashes += map(word_hash, part)
                for i, features in enumerate(_sets(part, n), at):
                    sizes.append(len(features))
                    sketches.append(sketch(features))
                    sigs.append(scheme.signatures(features[:0] if nameless[i] else features))
                every, own = np.concatenate(sigs), np.repeat(ids[at:end], [len(s) for s in sigs])
                at = end
                if not len(every):
                    continue
                order = np.argsort(every, kind="stable")
                ranked = every[order]
                starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                kind = np.full(len(every), FOLLOWER, np.int8)
                kind[order[starts]] = np.where(np.diff(np.append(starts, len(every))) > 1, SEVERAL, ALONE)
                key = (dealt(np.where(kind == FOLLOWER, mix(own.view(np.uint64)), every)) * 3 + kind).astype(narrow)
                order = np.argsort(key, kind="stable")
                key = key[order].astype(np.int64)
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                cuts = np.append(starts, len(key))
                columns = [pa.array(key[starts] // 3, pa.int32()), pa.array(key[starts] % 3, pa.int8()), lists(every[order].view(np.int64), cuts), lists(own[order], cuts), pa.nulls(len(starts), pa.binary()), pa.nulls(len(starts), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)
            one = np.arange(len(ids) + 1)
            columns = [pa.array(dealt(mix(ids.view(np.uint64))), pa.int32()), pa.array(np.full(len(ids), SIZE, np.int8)), lists(np.array(sizes, np.int64), one), pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch.column(0)), pa.array(hashes, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    made = classes.select("id", "t").mapInArrow(run, "to int, kind byte, sigs array<long>, ids array<long>, h binary, s array<long>")
    rows = made.repartitionById(parts, "to").select("to", "kind", "h", "s", F.inline(F.arrays_zip("sigs", "ids")).alias("sig", "id"))
    salt = F.when(F.col("kind") >= FOLLOWER, F.xxhash64("id")).otherwise(F.lit(0))
    counted = rows.withColumn("_salt", salt).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("sig", "_salt", "to")))
    is_size = F.col("kind") == SIZE
    kept = counted.where((F.col("kind") != ALONE) | (F.col("_c") > 1))
    return kept.select(F.when(~is_size, F.col("sig")).alias("sig"), "id", "h", F.when(is_size, F.col("sig")).alias("n"), "s")


def _memberships(members: DataFrame) -> DataFrame:
    """(sig, id, w): one signature for each distinct set of members, weighted by how many there are.

    Near copies share many signatures; those with the same members give the same
    pairs. Member sets are compared by size and two 64-bit exclusive-ors.
    """
    print_of = members.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "id")).alias("y"))
    kept = print_of.groupBy("c", "x", "y").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("w")).select("sig", "w")
    return members.join(kept, "sig").select("sig", "id", "w")


def _similar(num: int, den: int, na: Column, nb: Column, a: Column, b: Column) -> Column:
    """What sizes and sketches allow: false only for pairs below the threshold.

    Of two wide sketches the longer one is folded to the other's width: sizes so
    near differ by a factor of two at most.
    """
    base, apart = SKETCH // 64, F.lit(0)
    for i in range(base):
        apart = apart + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    within = lambda d: d * (den + num) <= (na + nb) * (den - num)
    first = (F.least(na, nb) * den >= F.greatest(na, nb) * num) & within(apart)
    wide = F.least(F.size(a), F.size(b)) - base

    def at(x: Column, i: Column) -> Column:
        folded = F.get(x, i + base).bitwiseXOR(F.get(x, i + wide + base))
        return F.when(F.size(x) - base > wide, folded).otherwise(F.get(x, i + base))

    def far(i: Column) -> Column:
        return F.bit_count(at(a, i).bitwiseXOR(at(b, i)))

    wider = F.aggregate(F.sequence(F.lit(0), wide - 1), F.lit(0), lambda x, i: x + far(i))
    return first & F.when(wide > 0, within(wider)).otherwise(F.lit(True))


@dataclass
class _Verifier:
    """Checks of pairs (a, b): by size and sketch, then exactly on the sets themselves.

    ``sketches`` has id, n and s of the candidates. Sets are made from the texts
    of those pairs only that the sketches let through.
    """

    docs: DataFrame
    sketches: DataFrame
    ws: Workspace
    n: int
    num: int
    den: int
    repeated: bool
    most_broadcast: int

    def slim(self, x: str) -> DataFrame:
        return self.sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))

    def likely(self, pairs: DataFrame, *more: str) -> DataFrame:
        c = F.col
        return pairs.join(self.slim("a"), "a").join(self.slim("b"), "b").where(_similar(self.num, self.den, c("na"), c("nb"), c("sa"), c("sb"))).select("a", "b", *more)

    def sets_of(self, ids: DataFrame, most: int) -> DataFrame:
        """(id, f): the sets of the texts with these ids, at most ``most``, which are broadcast up to ``most_broadcast``."""
        few, n = most <= self.most_broadcast or ids.count() <= self.most_broadcast, self.n
        source = self.docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        if self.repeated:
            source = source.dropDuplicates(["id", "t"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.slice(at, 512)
                    sets = _sets([normalise(t.as_py()) for t in part.column(1)], n)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "f"])

        return source.select("id", "t").mapInArrow(run, "id long, f array<long>")

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """Those of the pairs, a stored table, whose sets are similar enough, as a stored table; None if there are none."""
        if not (count := pairs.count()):
            return None
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = self.ws.stored(self.sets_of(ends, 2 * count), "sets")
        near = F.broadcast(pairs) if count <= self.most_broadcast else pairs
        side = lambda x: sets.join(near, F.col("id") == F.col(x)).select("a", "b", F.col("f").alias(f"f{x}"))
        shared = F.size(F.array_intersect("fa", "fb"))
        both = side("a").join(side("b"), ["a", "b"])
        found = self.ws.stored(both.where(shared * (self.den + self.num) >= (F.size("fa") + F.size("fb")) * self.num).select("a", "b").distinct(), "links")
        self.ws.drop(sets)
        return None if found.isEmpty() else found


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, cells: int = 3, rounds: int = 2, partners: int = 8, picks: int = 8, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = 500_000, ws: Workspace | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Documents link if the Jaccard similarity of their sets of distinct n-word
    shingles is at least num / den; component_id is the smallest id reachable.

    Texts with equal words are one class, which stands for all its copies. In
    each of at most ``rounds`` rounds every class takes the leaders of its
    signatures in other components, tries the sketches of the ``partners`` it
    shares most with and is verified against the best of them, which joins most
    of a large group of near copies at the cost of one pair each. One pass
    follows over the signatures of large components, with about ``picks``
    members of each component by hash, to join what one link suffices to join.
    A last pass takes all pairs that share a signature across components,
    leaving out those of a signature's largest component among themselves, so
    no link is lost; sizes and parity sketches, which never rule out a true
    link, are tested inside the join before a pair is made.

    Texts are read where they lie: they move only if more than
    ``most_broadcast`` ids are looked up, or if an id and its text are repeated.
    The result is a table in the workspace; all others are gone by then.

    Edge cases: a text without words has an empty set, links with nothing and is
    its own component; with fewer than n words the whole sequence is the one
    shingle; a row with a null id has its set's size, is not linked and has a null component_id;
    rows that repeat an id are one vertex, linked through any of their texts; an
    empty table gives no rows; other columns are ignored. Ids are integers.
    """
    spark, c = docs.sparkSession, F.col
    ship(spark)
    ws = ws or Workspace(spark, "ngram-join")
    scheme = PartEnum(num, den, cells)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    slim = ws.stored(text_classes(texts).select("id", "h"), "classes")
    firsts, repeated = _representatives(texts, slim, ws, most_broadcast)
    table = ws.stored(_signed(firsts, scheme, n), "signatures")
    sizes = table.where("sig is null").select("h", "id", "n", "s")
    if not slim.where("id is null").isEmpty():  # rows without an id can repeat a class
        sizes = sizes.groupBy("h").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("s").alias("s"))
    sizes = ws.stored(sizes, "sizes")
    members = ws.stored(_memberships(table.where("sig is not null").select("sig", "id")), "members")
    sketches = ws.stored(sizes.select("id", "n", "s").join(members.select("id").distinct(), "id", "left_semi"), "sketches")
    ws.keep(slim, sizes, members, sketches)
    check = _Verifier(texts, sketches, ws, n, num, den, repeated, most_broadcast)
    joined: DataFrame | None = None  # (v, root) over all classes so far
    given, members = members, members.withColumn("comp", F.col("id"))

    def absorb(links: DataFrame) -> DataFrame:
        """Joins components by links (a, b) between ids, into ``joined``; returns (v, root) of the components that changed."""
        nonlocal joined
        if joined is None:
            joined = connected(links, ws)
            return joined
        to = lambda x: joined.select(c("v").alias(x), c("root").alias(f"r{x}"))
        roots = connected(links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), ws)
        old, new = joined, roots.select(c("v").alias("_v"), c("root").alias("_r"))
        moved = old.join(new, c("root") == c("_v"), "left").select("v", F.coalesce("_r", "root").alias("root"))
        joined = ws.stored(moved.unionByName(roots.join(old.select("v"), "v", "left_anti")), "roots")
        return roots

    def relabel(roots: DataFrame) -> None:
        """Give ``members`` their new components; signatures within one component go."""
        nonlocal members, given
        relabelled = members.join(roots, c("comp") == c("v"), "left").select("sig", "id", "w", F.coalesce("root", "comp").alias("comp"))
        mixed = relabelled.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("sig")
        members = given = ws.stored(relabelled.join(mixed, "sig", "left_semi"), "members")
        ws.keep(slim, sizes, sketches, members, joined)

    def shares() -> tuple[DataFrame, DataFrame]:
        """How many members of each signature (sig) each component has (c), and which has most of them."""
        share = members.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c"))
        largest = share.groupBy("sig").agg(F.max(F.struct("c", "comp")).alias("m")).select("sig", c("m.comp").alias("big"), c("m.c").alias("most"))
        return share, largest

    def across(chosen: DataFrame) -> DataFrame:
        """The pairs of chosen members that share a signature across components and may be similar, but for those within the largest one."""
        rows = chosen.join(check.slim("i"), c("id") == c("i")).select("sig", "id", "comp", "ni", "si", (c("comp") == c("big")).alias("main"))
        left, right = rows.where("not main").alias("l"), rows.alias("r")
        meet = (c("l.sig") == c("r.sig")) & (c("l.comp") != c("r.comp")) & (c("r.main") | (c("l.id") < c("r.id"))) & _similar(num, den, c("l.ni"), c("r.ni"), c("l.si"), c("r.si"))
        return ws.stored(left.join(right, meet).select(c("l.id").alias("a"), c("r.id").alias("b")).distinct(), "pairs")

    for r in range(rounds):
        lead = members.groupBy("sig").agg(F.min(F.struct(F.xxhash64(F.lit(r), "id").alias("o"), c("id").alias("b"), c("comp").alias("c"))).alias("lead"))
        met = members.join(lead, "sig").where(c("comp") != c("lead.c")).groupBy(c("id").alias("a"), c("lead.b").alias("b")).agg(F.sum("w").alias("c"))
        ranked = met.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), F.xxhash64(F.lit(r), "b"))))
        near = check.likely(ranked.where(c("k") <= partners).select("a", "b", "k"), "k")
        best = ws.stored(near.groupBy("a").agg(F.min(F.struct("k", "b")).alias("m")).select("a", c("m.b").alias("b")), "pairs")
        if (links := check.links(best)) is None:
            break
        relabel(absorb(links))

    share, largest = shares()
    chosen = share.join(largest.where(c("most") >= 2 * picks), "sig").select("sig", "comp", "c", "big")
    few = members.join(chosen, ["sig", "comp"]).where(F.pmod(F.xxhash64(F.lit(-1), "id"), F.ceil(c("c") / picks)) == 0)
    tried = across(few)
    if (links := check.links(tried)) is not None:
        relabel(absorb(links))

    _, largest = shares()
    rest = across(members.join(largest, "sig"))
    ws.drop(given)
    if (links := check.links(rest)) is not None:
        absorb(links)

    out = slim.join(sizes.select(c("h").alias("_k"), c("id").alias("_rep"), c("n").alias("_n")), c("h") == c("_k"), "left")
    if joined is not None:
        out = out.join(joined.select(c("v").alias("_v"), c("root").alias("_root")), c("_rep") == c("_v"), "left")
    else:
        out = out.withColumn("_root", F.lit(None).cast("long"))
    own = F.when(c("id").isNull() | (c("_n") == 0), c("id")).otherwise(F.coalesce("_root", "_rep"))
    result = ws.stored(out.select(c("id").alias("doc_id"), c("_n").alias("n_shingles"), own.alias("component_id")), "components")
    ws.keep(result)
    return result


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, root) for each vertex of these edges that is not the smallest of its component; root is that one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, a, b = np.arange(len(ids)), at[: len(a)], at[len(a) :]
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(up != np.arange(len(ids)))
    return ids[below], ids[up[below]]


def _contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(v, root): edges that connect the same vertices as the edges (a, b), a forest for each ``most`` of a task or all it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                parts.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
                size += len(batch)
            if parts and (batch is None or size >= most):
                found = forest(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["v", "root"])
                parts, size = [], 0

    return edges.select("a", "b").mapInArrow(run, "v long, root long")


def connected(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(v, root) for each vertex of the edges (a, b) that is not the smallest one reachable; root is that one.

    Each task joins the edges it has into trees of depth one, which settles
    small tables at once. Until all are such trees, large-star and small-star
    steps alternate and their edges are joined in tasks again. Each step sends a
    vertex's neighbours to the smallest one, which is found by a map-side
    minimum and joined back, so no neighbourhood is gathered in one task; each
    step is a table, and the one before goes. None of this ever raises a
    vertex's smallest neighbour, and a round that lowers none has ended, so the
    rounds end.
    """
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    v, root, a, b, m = map(F.col, ("v", "root", "a", "b", "_m"))
    now = ws.stored(_contracted(edges.where("a <> b").select("a", "b").distinct()), "edges")
    while True:
        ends = now.select(F.inline(F.array(pair(root, F.lit(None).cast("long")), pair(v, root))))
        if ends.groupBy("a").agg(F.count("b").alias("_c"), F.count(F.lit(1)).alias("_n")).where("_c > 0 and _n > 1").isEmpty():
            return now  # what has a root is nobody's root and has no other
        both = now.select(F.inline(F.array(pair(v, root), pair(root, v))))
        low = both.groupBy(a.alias("_a")).agg(F.min("b").alias("_b")).select("_a", F.least("_a", "_b").alias("_m"))
        large = ws.stored(both.join(low, a == F.col("_a")).where(b > a).select(m.alias("a"), "b").distinct(), "large")
        ws.drop(now)
        least = large.groupBy(b.alias("_b")).agg(F.min("a").alias("_m"))
        small = large.join(least, b == F.col("_b")).select(F.inline(F.array(pair(m, a), pair(m, b))))
        now = ws.stored(_contracted(small.where("a <> b").distinct()), "edges")
        ws.drop(large)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, cells: int = 3, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = 500_000) -> DataFrame:
    """The rows of ``docs`` with one document of each component, the one with the smallest id.

    Rows with a null id stay; for other edge cases see ``ngram_components``. All
    columns are kept, whatever their names. The dropped ids are broadcast up to
    ``most_broadcast`` and joined by a shuffle above that.
    """
    ws = Workspace(docs.sparkSession, "one-of-each")
    found, gone = ngram_components(docs, n, num, den, cells, doc_id=doc_id, text=text, most_broadcast=most_broadcast, ws=ws), fresh(docs, "_gone")
    dropped = ws.stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "near")
    ws.keep(dropped)
    few = dropped.count() <= most_broadcast
    return docs.join(F.broadcast(dropped) if few else dropped, docs[doc_id] == dropped[gone], "left_anti")
