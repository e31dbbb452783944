"""Grouped, global, distinct and cube aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.operators import mapreduce, reduce
from burrstone.operators.ordering import row_positions
from burrstone.registry import query
from burrstone.session import table

DIMS = ["l_returnflag", "l_linestatus", "l_linenumber"]
CUBE_SQL = """SELECT l_returnflag, l_linestatus, l_linenumber, GROUPING(l_returnflag, l_linestatus, l_linenumber) AS view,
CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber) HAVING GROUPING(l_returnflag, l_linestatus, l_linenumber) <> 7"""


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*DIMS, F.col("l_quantity").cast("long").alias("quantity"))


@query("group_sum_count", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY ALL")
def group_sum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("user_fold", """SELECT k, s AS state FROM (SELECT o_custkey AS k, list_reduce([0::BIGINT] || list(o_orderkey % 97 ORDER BY o_orderkey), lambda a, b: (a * 31 + b) % 1000003) AS s
FROM orders GROUP BY o_custkey)""")
def user_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderkey") % 97).alias("v"))
    return reduce.fold(o, ["k"], "v", ["o_orderkey"], F.lit(0).cast("long"), lambda s, x: (s * 31 + x) % 1000003)


@query("keep_first", """SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"])


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("global_reduce_all_ops", """SELECT CAST(sum(v) AS BIGINT) AS r_add, max(v) AS r_max, min(v) AS r_min, round(product(w), 6) AS r_prod,
bool_or(v <> 0) AS r_or, bool_and(v <> 0) AS r_and, bit_or(v) AS r_bor, bit_and(v) AS r_band, bit_xor(v) AS r_bxor, count(*) FILTER (v <> 0) % 2 = 1 AS r_xor
FROM (SELECT o_orderkey - 50 AS v, CASE WHEN o_orderkey < 20 THEN 1 + o_orderkey / 100.0 ELSE 1 END AS w FROM orders)""")
def global_reduce_all_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") - 50).alias("v"),
        F.when(F.col("o_orderkey") < 20, 1 + F.col("o_orderkey") / 100.0).otherwise(F.lit(1.0)).alias("w"),
    )
    ints = reduce.reduce_all(v, "v", [o for o in reduce.REDUCERS if o != "prod"])
    return ints.crossJoin(v.agg(F.round(F.product("w"), 6).alias("r_prod")))


@query("all_reduce", "SELECT c_custkey, c_nationkey - (SELECT max(c_nationkey) FROM customer) AS below FROM customer")
def all_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return reduce.all_reduce(c, "c_nationkey", "max", "m").select("c_custkey", (F.col("c_nationkey") - F.col("m")).alias("below"))


@query("array_allreduce", """SELECT pos, CAST(sum(v) AS BIGINT) AS total FROM (SELECT unnest([l_linenumber, l_quantity::BIGINT, l_suppkey]) AS v, unnest([0, 1, 2]) AS pos FROM lineitem) GROUP BY pos""")
def array_allreduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.col("l_suppkey")).alias("a"))
    return reduce.reduce_arrays(a, "a").select(F.posexplode("a").alias("pos", "total"))


@query("argmax", """SELECT l_returnflag, argmax, max_value, argmin, min_value FROM (SELECT l_returnflag,
arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, -(l_orderkey * 10 + l_linenumber))) AS argmax, max(l_extendedprice) AS max_value,
arg_min(l_orderkey * 10 + l_linenumber, (l_extendedprice, l_orderkey * 10 + l_linenumber)) AS argmin, min(l_extendedprice) AS min_value FROM lineitem GROUP BY l_returnflag)""")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_extendedprice")
    return reduce.arg_best(li, ["l_returnflag"], "line", "l_extendedprice")


@query("any_all_sum", "SELECT o_orderstatus, bool_or(o_totalprice > 200000) AS any_large, bool_and(o_totalprice > 1000) AS all_above, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")
def any_all_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.bool_or(F.col("o_totalprice") > 200000).alias("any_large"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_above"), F.sum("o_custkey").alias("total")
    )


@query("summary_stats", """SELECT event_type, n, round(mean, 6) AS mean, round(stddev, 6) AS stddev, least, largest FROM (SELECT event_type, count(value) AS n, avg(value) AS mean,
coalesce(stddev_samp(value), 0) AS stddev, min(value) AS least, max(value) AS largest FROM events GROUP BY event_type)""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reduce.summary(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query("quartiles", """WITH v AS (SELECT o_totalprice AS x FROM orders) SELECT round(min(x), 4) AS least, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median,
round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS largest, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS stddev, round(count(*) / sum(1 / x), 4) AS harmonic_mean,
round(stddev_samp(1 / x) / sqrt(count(*) - 1) * pow(count(*) / sum(1 / x), 2), 4) AS harmonic_stddev FROM v""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = reduce.quartiles(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x")), "x")
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


@query("vector_mean", "SELECT label, pos, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return reduce.vector_mean(e, "v", ["label"]).select("label", F.posexplode("v").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


@query("two_norm", "SELECT round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS norm, round(sqrt(sum((c_acctbal - c_nationkey) * (c_acctbal - c_nationkey))), 4) AS difference FROM customer")
def two_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey")
    gap = F.col("c_acctbal") - F.col("c_nationkey")
    return c.agg(F.round(F.sqrt(F.sum(F.col("c_acctbal") * F.col("c_acctbal"))), 4).alias("norm"), F.round(F.sqrt(F.sum(gap * gap)), 4).alias("difference"))


@query("counter", "SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) AS events FROM events")
def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count(F.lit(1)).alias("events"))


WORDS_SQL = "SELECT l_partkey % 33 AS word, count(*) AS n FROM lineitem GROUP BY 1"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 33).alias("word"))


@query("wordcount", WORDS_SQL)
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map, combine and reduce as one aggregation: Catalyst combines before the shuffle."""
    return _words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("wordcount_combined", WORDS_SQL)
def wordcount_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with user functions and a combiner."""
    add = lambda k, vs: [(k, sum(vs))]
    return mapreduce.map_reduce(_words(spark, sf_dir), lambda r: [(r["word"], 1)], add, "word long, n long", "word long, n long", combiner=add)


def _longest(event_type: str, sizes) -> list[tuple]:
    most = n = 0
    for n, size in enumerate(sizes, 1):
        most = max(most, size)
    return [(event_type, most, n)]


@query("map_reduce_plain", "SELECT event_type, max(length(props)) AS longest, count(*) AS n FROM events GROUP BY event_type")
def map_reduce_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No combiner: all values of a key meet in one call, which reads them batch by batch and holds none of them."""
    return mapreduce.map_reduce(
        table(spark, sf_dir, "events").select("event_type", "props"), lambda r: [(r["event_type"], len(r["props"]))],
        _longest, "event_type string, size long", "event_type string, longest long, n long",
    )


@query("flat_map", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token")
def flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("cube_views", CUBE_SQL)
def cube_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.cube(_quantities(spark, sf_dir), DIMS, ["quantity"])


@query("cube_lattice", CUBE_SQL)
def cube_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.cube_lattice(_quantities(spark, sf_dir), DIMS, ["quantity"])


@query("view_sizes", f"SELECT view, count(*) AS n FROM ({CUBE_SQL}) GROUP BY view")
def view_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.cube(_quantities(spark, sf_dir), DIMS, ["quantity"]).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


@query("view_checksum", f"""WITH c AS ({CUBE_SQL}) SELECT view, CAST(sum((r * quantity) % 31415) AS BIGINT) AS checksum FROM (SELECT view, quantity,
row_number() OVER (PARTITION BY view ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_linenumber NULLS FIRST) AS r FROM c) GROUP BY view""")
def view_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers by a scan over ranges of (view, dimensions): the finest view is as large as its groups, so no window
    takes a whole view. A view starts at its least position."""
    c = reduce.cube(_quantities(spark, sf_dir), DIMS, ["quantity"])
    placed = row_positions(c, ["view", *DIMS])
    starts = placed.groupBy("view").agg(F.min("position").alias("start"))  # a row for each view
    r = F.col("position") - F.col("start") + 1
    return placed.join(F.broadcast(starts), "view").groupBy("view").agg(F.sum((r * F.col("quantity")) % 31415).alias("checksum"))


@query("rollup_prefix", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).rollup("l_returnflag", "l_linestatus").agg(F.sum("quantity").alias("quantity"))


@query("metrics_summary", """SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS most,
count(*) FILTER (value < 50) AS low, count(*) FILTER (value >= 50) AS high FROM events GROUP BY event_type""")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("most"),
        F.count_if(F.col("value") < 50).alias("low"), F.count_if(F.col("value") >= 50).alias("high"),
    )
