"""Sort, rank and scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, order: Sequence[str], parts: int | None) -> DataFrame:
    """Rows in ranges of the order, each with its range's number, cut in the checkpoint folder: the ranges are sampled,
    and must be the same for the sums and for the rows."""
    from burrstone.session import cut

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def prefix_sum(df: DataFrame, value: str, order: Sequence[str], name: str = "before", parts: int | None = None) -> DataFrame:
    """df with the exclusive running sum of a column, in three phases: sums of ranges, a scan over those few sums, and a
    scan inside each range. No step brings all rows to one task, as a window without partitions would."""
    rows = _ranged(df, order, parts)
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    # As many rows as there are ranges.
    start = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(start), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__in") + F.col("__start")).drop("__part", "__in", "__start")
    )


def row_positions(df: DataFrame, order: Sequence[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """df with the 0-based place of each row in a total order, without a global window."""
    return prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, name, parts).drop("__one")


def global_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """df with the number of rows of smaller keys: counts by key, a scan over the keys, and a join back.

    Equal keys share a rank, so a hot key is one counted row in the scan. The join is split by adaptive execution."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(prefix_sum(counts, "__n", [key], name).select(key, name), key)


def bucket_histogram(df: DataFrame, key: str, low_bits: int) -> DataFrame:
    """Rows by the high bits of a key."""
    return df.groupBy(F.shiftright(F.col(key), low_bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bucket_sort(df: DataFrame, order: Sequence[Column | str], parts: int) -> DataFrame:
    """Ranges by sampled bounds, each sorted: a global sort whose pieces stay apart."""
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def sortedness_violations(df: DataFrame, position: str, key: str, parts: int | None = None) -> DataFrame:
    """Rows whose key is less than that of the row before (equal positions in order of key). Ranges are checked inside and at their borders."""
    rows = _ranged(df.select(position, key), [position], parts)
    inside = Window.partitionBy("__part").orderBy(position, key)
    within = rows.withColumn("previous", F.lag(key).over(inside)).where(F.col("previous") > F.col(key)).select(position, "previous", key)
    edges = rows.groupBy("__part").agg(
        F.min(F.struct(position, key)).alias("first"), F.max(F.struct(position, key)).alias("last")
    )
    border = Window.partitionBy(F.lit(0)).orderBy("__part")
    across = edges.withColumn("previous", F.lag(F.col(f"last.{key}")).over(border)).where(F.col("previous") > F.col(f"first.{key}")).select(
        F.col(f"first.{position}").alias(position), "previous", F.col(f"first.{key}").alias(key)
    )
    return within.unionByName(across)
