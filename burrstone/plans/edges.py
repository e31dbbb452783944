"""The canonical edge relation of the driver's tables, and the SQL that defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.session import table

#: CTE text for oracles; the DataFrame below is the same relation.
EDGES_CTE = "edges AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loop-free directed edges from every line's order to its part, as often as there are lines. The two columns and the
    comparison reach the Parquet scan."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return rows.where("src <> dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct loop-free directed edges, from every line's order to its part; the ids of both share one space. The
    relation grows with the tables, and a vertex has about as many neighbours at any scale."""
    return lines(spark, sf_dir).distinct()
