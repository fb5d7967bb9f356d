"""Readers and converters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import LazyFrame
from ..session import get_spark


def scan(table: Any) -> LazyFrame:
    """A frame over an Arrow table, a Spark DataFrame or another frame."""
    return LazyFrame(table)



def from_arrow(table: Any) -> LazyFrame:
    return LazyFrame(table)


def from_pandas(df: Any) -> LazyFrame:
    """The columns of a pandas frame; its index is dropped."""
    import pyarrow as pa

    return LazyFrame(pa.Table.from_pandas(df, preserve_index=False))


def from_polars(df: Any) -> LazyFrame:
    return LazyFrame(df.to_arrow())


def read_csv(path: str, **options: Any) -> LazyFrame:
    """CSV with a header and inferred types; ``schema=`` saves the pass that infers them."""
    return LazyFrame(get_spark().read.csv(path, **({"header": True} | ({} if "schema" in options else {"inferSchema": True}) | options)))


def read_parquet(path: str, **options: Any) -> LazyFrame:
    return LazyFrame(get_spark().read.parquet(path, **options))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_tables(folder: str, *names: str) -> dict[str, LazyFrame]:
    """The named Parquet tables of a folder as frames."""
    return {n: read_parquet(f"{folder}/{n}.parquet") for n in names}


__all__ = ["from_arrow", "from_pandas", "from_polars", "load_tables", "read_csv", "read_parquet", "scan", "table"]
