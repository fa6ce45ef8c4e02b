"""Shared helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.session import shared_dir, written

__all__ = ["WORD", "let", "partitions", "read", "shared_dir", "small_batches", "unused", "written"]

#: Characters that end a word: `[^\x20\x09-\x0D]+` is a word.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Python tasks get their rows in batches of some MB, so that a worker's memory doesn't depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be a column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def let(value: Column, f) -> Column:
    """`f(value)` with `value` evaluated once, however often `f` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
