"""Helpers shared by the corpus operators."""

from __future__ import annotations

import importlib
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control blanks.
BLANKS = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one in ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests, a single machine):
    a temporary folder takes its place. On a cluster such a folder would be
    another one on each machine, so there a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Spark 4.1's switch to drop a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _before = threading.Lock(), []


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Queries of this session drop their shuffle files while any thread is inside; the last one out restores the setting."""
    with _lock:
        _before.append(_before[0] if _before else spark.conf.get(CLEANUP, "false"))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            value = _before.pop()
            if not _before:
                spark.conf.set(CLEANUP, value)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """The intermediate tables of one operator call, in a folder of their own below the shared one.

    A table cuts the lineage in a way that survives lost executors and gives
    later joins real sizes to plan by. It is deleted as soon as nothing reads it
    any more: a call ends with ``keep``, which leaves what its result reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables: list[tuple[DataFrame, str]] = []
        self._made = 0

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back. The table stands for the query, whose shuffle files go when it ends."""
        self._made += 1
        path = f"{self.folder}/{self._made}-{label}"
        with shuffle_files_go(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``stored`` returned; nothing may read them after that."""
        for t, path in list(self._tables):
            if any(t is x for x in tables):
                delete(self.spark, path)
                self._tables.remove((t, path))

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[t for t, _ in self._tables if not any(t is x for x in tables)])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    name = __name__.split(".")[0]
    root = Path(importlib.import_module(name).__file__).parent
    out = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / f"{name}.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(str(out))
    _shipped.add(context.applicationId)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that models never learn from.

    A null id is held out as well.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def gapless(df: DataFrame, group: list[str], order: list[str], spread: str, out: str, rows: int, part_rows: int = 100_000, most_parts: int = 1024) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without putting a group in one task.

    ``spread`` is an integer column whose hash deals the rows of a group into
    parts; rows are numbered inside their part by ``order`` and shifted by the
    exact sizes of the parts before. ``rows`` is the size of the whole table, so
    one group may hold all of it: there are enough parts for that, up to
    ``most_parts``. Only the part sizes, at most ``most_parts`` for each group,
    are broadcast. One exchange moves the rows.
    """
    parts = max(1, min(most_parts, -(-rows // part_rows)))
    p, off = fresh(df, "_part"), fresh(df, "_off")
    dealt = df.withColumn(p, F.pmod(F.xxhash64(F.lit(7), spread), F.lit(parts)))
    before = Window.partitionBy(*group).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, p).agg(F.count(F.lit(1)).alias(off))
    starts = sizes.withColumn(off, F.coalesce(F.sum(off).over(before), F.lit(0)))
    renamed = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(p).alias("_gp"), off)
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col(p) == F.col("_gp")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    within = Window.partitionBy(*group, p).orderBy(*order)
    joined = dealt.join(F.broadcast(renamed), cond)
    return joined.withColumn(out, F.col(off) + F.row_number().over(within) - 1).drop(p, off, "_gp", *[f"_g{i}" for i in range(len(group))])
