"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontora.shared import scratch, stored

__all__ = ["scratch", "stored"]

#: The six characters that separate words everywhere in this subpackage.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; no words for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return let(bare, lambda b: F.when(F.length(b) == 0, F.array().cast("array<string>")).otherwise(F.split(b, WHITE_RUN)))


def word_count(text: Column) -> Column:
    """The number of words, without building them; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str], what: str = "totals") -> DataFrame:
    """df with, for each (value, out) of totals, out = sum of value over all rows before, in the order given.

    Rows are range-partitioned and sorted; each partition adds the totals of the partitions before it.
    Only one row of sums per partition is put together, never rows. Partitioning is fixed by writing the table.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *order).withColumn("_rt_part", F.spark_partition_id()).withColumn("_rt_tie", tie)
    ranged = stored(ranged, what)
    sums = ranged.groupBy("_rt_part").agg(*[F.sum(v).alias(f"_rt_{out}") for v, out in totals.items()])
    upto = Window.orderBy("_rt_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_rt_part", *[F.coalesce(F.sum(f"_rt_{out}").over(upto), F.lit(0)).alias(f"_rt_{out}") for out in totals.values()])
    inner = Window.partitionBy("_rt_part").orderBy(*order, "_rt_tie").rowsBetween(Window.unboundedPreceding, -1)
    before = {out: F.col(f"_rt_{out}") + F.coalesce(F.sum(v).over(inner), F.lit(0)) for v, out in totals.items()}
    # one row per partition is broadcast
    return ranged.join(F.broadcast(offsets), "_rt_part").withColumns(before).drop("_rt_part", "_rt_tie", *[f"_rt_{out}" for out in totals.values()])
