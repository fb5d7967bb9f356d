"""Mixing sources to target weights by Poisson replication.

Native: DataFrame expressions only. Each document gets a count from a Poisson
distribution whose mean is its source's repetition rate: a hash of (seed, id)
gives a uniform number and the distribution is inverted on it. No row depends
on another one, so a source that holds a third of all rows needs no shuffle;
the only exchange is the global shuffle by a random key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh

#: A mean above this is drawn as a sum of equal parts, so that exp(-mean) keeps its digits.
PART = 8.0
#: Counts of one part above this have a probability under 1e-30.
LONGEST = 60


def uniform(seed: int, *what: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the given values."""
    parts = [F.lit(str(seed)), *[F.coalesce(w.cast("string"), F.lit("")) for w in what]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, budget: float = 1.0, source: str = "source", text: str = "text", ws: Workspace | None = None) -> DataFrame:
    """For each source: its bytes and its mean repetition rate.

    ``weights`` maps sources to target shares (sources not named get 0); without
    it the share of a source follows its bytes to the power ``alpha``.
    ``budget`` is the size of the mixture in multiples of the input.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    sums = docs.select(F.col(source).alias("_src"), size.alias("_b")).groupBy("_src").agg(F.sum("_b").alias("_bytes"))
    if weights is None:
        share = F.pow(F.col("_bytes").cast("double"), F.lit(alpha))
    else:
        share = F.lit(0.0)
        for k, v in weights.items():
            share = F.when(F.col("_src").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(share)
    ws = ws or Workspace(docs.sparkSession, "mix")
    shares = ws.stored(sums.withColumn("_share", share), "mix-sources")
    total, wanted = shares.agg(F.sum("_bytes"), F.sum("_share")).first()
    scale = budget * float(total or 0) / wanted if wanted else 0.0
    return shares.select("_src", "_bytes", (F.lit(scale) * F.col("_share") / F.col("_bytes")).alias("_rate"))


def poisson_table(rate: Column) -> Column:
    """The distribution function at 0, 1, ... for a mean of at most ``PART``."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), start, lambda a, i: F.struct((a["p"] * rate / i).alias("p"), F.array_append(a["c"], F.element_at(a["c"], -1) + a["p"] * rate / i).alias("c")))
    return grown["c"]


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, budget: float = 1.0, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text", most_broadcast: int = 50_000, extras: bool = True) -> DataFrame:
    """The rows of ``docs``, each repeated as its Poisson count says, in random order.

    With ``extras`` three columns follow those of ``docs``: ``mix_copy`` (from
    1), ``mix_copies`` and ``mix_key`` (the random key of the order, 0 to 1);
    where ``docs`` has such names already, an underscore is added.

    Edge cases: rows with a null source are a source of their own; a null id
    hashes as an empty string; rows that repeat an id draw the same count; an
    empty text weighs one byte; a source of weight 0 goes; an empty table gives
    no rows. The rates are broadcast up to ``most_broadcast`` sources; above
    that they are joined under 32 salts.
    """
    ws = Workspace(docs.sparkSession, "mix")
    rates = source_rates(docs, weights, alpha, budget, source, text, ws)
    src, parts, cdf, salt, own, n, i, key = (fresh(docs, f"_mix_{x}") for x in ("src", "parts", "cdf", "salt", "own", "n", "i", "key"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int")
    table = ws.stored(rates.select(F.col("_src").alias(src), pieces.alias(parts), poisson_table(F.col("_rate") / pieces).alias(cdf)), "rates")
    ws.keep(table)
    if table.count() <= most_broadcast:
        joined = docs.join(F.broadcast(table), docs[source].eqNullSafe(table[src]))
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(31))))
        left = docs.withColumn(own, F.pmod(F.xxhash64(F.col(doc_id)), F.lit(32)))
        joined = left.join(salted, left[source].eqNullSafe(salted[src]) & (left[own] == salted[salt])).drop(salt, own)

    def drawn(part: Column) -> Column:
        u = uniform(seed, F.col(doc_id), part)
        return F.size(F.filter(cdf, lambda c: c <= u))

    total = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, part: a + drawn(part))
    counted = joined.withColumn(n, total).where(F.col(n) > 0)
    copies = counted.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = copies.withColumn(key, uniform(seed + 1, F.col(doc_id), F.col(i)))
    shuffled = keyed.repartition(F.col(key)).sortWithinPartitions(key)
    added = [F.col(x).alias(fresh(docs, name)) for x, name in ((i, "mix_copy"), (n, "mix_copies"), (key, "mix_key"))] if extras else []
    return shuffled.select(*[docs[c] for c in docs.columns], *added)
