"""Equi-joins in several physical shapes, semi and theta joins, triplet views, star patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.plans.edges import EDGES_CTE, edges
from burrstone.registry import query
from burrstone.session import table

ORDERS_CUSTOMERS = "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")


@query("hash_join", ORDERS_CUSTOMERS)
def hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides hashed by key to reducers."""
    return _orders(spark, sf_dir).join(_customers(spark, sf_dir).hint("shuffle_hash"), "o_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("index_join", ORDERS_CUSTOMERS)
def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build and probe; Spark sends the built side to every task only if its measured size allows that."""
    return _orders(spark, sf_dir).join(_customers(spark, sf_dir), "o_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("symmetric_join", ORDERS_CUSTOMERS)
def symmetric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither side is a build side: both are sorted and merged."""
    return _orders(spark, sf_dir).join(_customers(spark, sf_dir).hint("merge"), "o_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("join_concat_fields", "SELECT a.i AS lk, 1000 * a.i AS lv, 2 * b.i AS rk, 10 * b.i AS rv FROM range(10) a(i) JOIN range(7) b(i) ON a.i = 2 * b.i")
def join_concat_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = spark.range(10).select(F.col("id").alias("lk"), (F.col("id") * 1000).alias("lv"))
    right = spark.range(7).select((F.col("id") * 2).alias("rk"), (F.col("id") * 10).alias("rv"))
    return left.join(right, F.col("lk") == F.col("rk"))


@query("join_update", """SELECT c_custkey AS k, c_nationkey + coalesce(n, 0) AS v FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def join_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return c.join(n, "k", "left").select("k", (F.col("c_nationkey") + F.coalesce("n", F.lit(0))).alias("v"))


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("theta_join", """SELECT a.l_orderkey, a.l_linenumber AS l1, b.l_linenumber AS l2 FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_quantity < b.l_quantity""")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a = li.select("l_orderkey", F.col("l_linenumber").alias("l1"), F.col("l_quantity").alias("q1"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("l2"), F.col("l_quantity").alias("q2"))
    return a.join(b, "l_orderkey").where("l1 < l2 AND q1 < q2").select("l_orderkey", "l1", "l2")


@query("star_join", """WITH t AS (SELECT l_orderkey AS s, l_returnflag AS p, l_suppkey AS o FROM lineitem)
SELECT a.s, a.o AS o1, b.o AS o2, c.o AS o3 FROM t a JOIN t b ON a.s = b.s JOIN t c ON a.s = c.s
WHERE a.p = 'R' AND b.p = 'A' AND c.p = 'N'""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_suppkey").alias("o"))
    arm = lambda p, name: t.where(F.col("p") == p).select("s", F.col("o").alias(name))
    return arm("R", "o1").join(arm("A", "o2"), "s").join(arm("N", "o3"), "s")


@query("triplets", f"""WITH {EDGES_CTE} SELECT src, dst, a.n AS src_degree, b.n AS dst_degree FROM edges
JOIN (SELECT src AS id, count(*) AS n FROM edges GROUP BY src) a ON src = a.id
JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) b ON dst = b.id""")
def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    a = e.groupBy("src").agg(F.count(F.lit(1)).alias("src_degree"))
    b = e.groupBy("dst").agg(F.count(F.lit(1)).alias("dst_degree"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", "src_degree", "dst_degree")


@query("adjacency_of_subset", f"WITH {EDGES_CTE} SELECT src, dst FROM edges WHERE src % 10 = 3")
def adjacency_of_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    subset = e.select("src").distinct().where("src % 10 = 3")
    return subset.join(e, "src").select("src", "dst")


@query("broadcast_small", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def broadcast_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions are fixed lists of 25 and 5 rows, whatever the scale, so both are sent to every task."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("residual_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount <> 0.05 AND l_tax > 0.02 AND l_returnflag = 'R'")
def residual_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_quantity < 10 AND l_discount <> 0.05D AND l_tax > 0.02D AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("computed_projection", "SELECT s_suppkey, s_suppkey * 2 + 1 AS odd, s_nationkey % 5 AS bucket, s_acctbal * 2 AS doubled FROM supplier")
def computed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", (F.col("s_suppkey") * 2 + 1).alias("odd"), (F.col("s_nationkey") % 5).alias("bucket"), (F.col("s_acctbal") * 2).alias("doubled"))


@query("range_loop", "SELECT i, i * i AS square FROM range(5, 105) t(i)")
def range_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(5, 105).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("square"))


@query("nested_loop_expand", "SELECT n_nationkey, unnest(range(n_regionkey + 1)) AS k FROM nation")
def nested_loop_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_regionkey").cast("long"))).alias("k"))


@query("per_partition_run", "SELECT count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem")
def per_partition_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code that runs once in each partition; its partial results are summed."""

    def run(frames):
        import pandas as pd

        n = q = 0
        for f in frames:
            n, q = n + len(f), q + int(f["l_quantity"].sum())
        yield pd.DataFrame({"n": [n], "q": [q]})

    parts = table(spark, sf_dir, "lineitem").select("l_quantity").mapInPandas(run, "n long, q long")
    return parts.agg(F.sum("n").alias("n_rows"), F.sum("q").alias("quantity"))


@query("time_range", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-05 00:00:00' AND ts < timestamp_ntz'2024-01-12 00:00:00'").select("event_id", "user_id", "event_type")


@query("valid_vertices", f"WITH {EDGES_CTE} SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def valid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrstone.operators.graph import endpoints

    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(endpoints(edges(spark, sf_dir)), "id", "left_semi")
