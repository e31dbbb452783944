"""Keyed and indexed collections as DataFrames: upserts, vectors, batched reads and writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """base with the last change of each key by an order; keys not in base are added."""
    rest = [c for c in base.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__n"))
    pick = [F.when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    return base.join(last, list(keys), "full").select(*keys, *pick)


def insert_or_update(base: DataFrame, changes: DataFrame, key: str, value: str, on_insert: Column, on_update) -> DataFrame:
    """For each changed key, on_update(old value, number of changes), or on_insert for a new key."""
    counted = changes.groupBy(key).agg(F.count(F.lit(1)).alias("__k"))
    new = F.when(F.col("__k").isNull(), F.col(value)).when(F.col(value).isNull(), on_insert).otherwise(on_update(F.col(value), F.col("__k")))
    return base.join(counted, key, "full").select(key, new.alias(value))


def push(vector: DataFrame, more: DataFrame, order: Sequence[str]) -> DataFrame:
    """vector (idx, value) with the rows of more behind it, in order."""
    from burrstone.operators.ordering import row_positions

    size = vector.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("__size"))
    added = row_positions(more, order, "__p").crossJoin(F.broadcast(size)).select((F.col("__p") + F.col("__size")).alias("idx"), "value")
    return vector.select("idx", "value").unionByName(added)


def _ends(vector: DataFrame) -> DataFrame:
    return F.broadcast(vector.agg(F.min("idx").alias("__lo"), F.max("idx").alias("__hi")))


def pop(vector: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The last n values, and the vector without them."""
    v = vector.crossJoin(_ends(vector))
    gone = F.col("idx") > F.col("__hi") - n
    return v.where(gone).select("idx", "value"), v.where(~gone).select("idx", "value")


def dequeue(vector: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n values (from the old head), and the vector without them."""
    v = vector.crossJoin(_ends(vector))
    gone = F.col("idx") < F.col("__lo") + n
    return v.where(gone).select("idx", "value"), v.where(~gone).select("idx", "value")


def read_at(array: DataFrame, addresses: DataFrame) -> DataFrame:
    """Values (idx, value) at the addresses (idx)."""
    return addresses.join(array, "idx")


def write_at(array: DataFrame, writes: DataFrame, order: str) -> DataFrame:
    """The array after the last write to each address."""
    last = writes.groupBy("idx").agg(F.max_by("value", order).alias("__w"))
    return array.join(last, "idx", "left").select("idx", F.coalesce("__w", "value").alias("value"))


def fetch_and_add(array: DataFrame, adds: DataFrame, order: Sequence[str]) -> DataFrame:
    """For each add (idx, amount), the value it would have found: the cell plus the adds before it in order."""
    from pyspark.sql import Window

    before = Window.partitionBy("idx").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return adds.withColumn("__b", F.coalesce(F.sum("amount").over(before), F.lit(0))).join(array, "idx").select(
        "idx", *order, "amount", (F.col("value") + F.col("__b")).alias("found")
    )


def compare_and_swap(array: DataFrame, swaps: DataFrame) -> DataFrame:
    """The array after one swap (idx, expected, value) at most for each address."""
    s = swaps.select("idx", "expected", F.col("value").alias("__new"))
    return array.join(s, "idx", "left").select("idx", F.when(F.col("value") == F.col("expected"), F.col("__new")).otherwise(F.col("value")).alias("value"))


def scatter(size: int, targets: DataFrame, op: Column, empty: int = 0) -> DataFrame:
    """value at each index below size: op over the targets (idx, i) that fall on it. Updates are combined before the
    shuffle, so an index that a third of all updates hit costs no more than any other."""
    spark = targets.sparkSession
    hit = targets.groupBy("idx").agg(op.alias("value"))
    return spark.range(size).withColumnRenamed("id", "idx").join(hit, "idx", "left").select("idx", F.coalesce("value", F.lit(empty)).cast("long").alias("value"))
