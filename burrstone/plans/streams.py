"""Streaming queries; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.registry import query
from burrstone.session import table
from burrstone.sources.files import scratch
from burrstone.streaming import stream_join


@query("stream_symmetric_join", "SELECT o_custkey, o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_symmetric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    left, right, out, mark = (scratch(spark, n) for n in ("left", "right", "joined", "mark"))
    orders.repartition(3).write.parquet(left)
    customers.repartition(2).write.parquet(right)
    return stream_join(spark, left, right, orders.schema, customers.schema, "o_custkey", out, mark).select("o_custkey", "o_orderkey", "c_nationkey")
