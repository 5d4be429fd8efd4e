"""Where queries and their oracles register, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lined(df: DataFrame, keys: list[str], order: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """One row a key: the lines in order, joined."""
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["_line"]), sep).alias("lines"))


def text_of(*parts) -> Column:
    """A text from literals (str) and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def counter(name: str) -> Column:
    """An adapter's count, 0 where it changed nothing."""
    return F.coalesce(F.try_element_at("stats", F.lit(name)), F.lit(0)).alias(name)
