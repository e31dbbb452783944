"""Sort, rank, scan, set and container queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burrstone.operators import containers, intersect, ordering
from burrstone.operators.graph import symmetrize
from burrstone.plans.edges import EDGES_CTE, edges, lines
from burrstone.registry import query
from burrstone.session import table


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys in cents with the line's own number."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("key")
    )


KEYS_SQL = "SELECT l_orderkey * 10 + l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS key FROM lineitem"


@query("prefix_sum", "SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders")
def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ordering.prefix_sum(o, "o_custkey", ["o_orderkey"]).select("o_orderkey", "before")


@query("bucket_offsets", f"""WITH k AS ({KEYS_SQL}), h AS (SELECT key >> 18 AS bucket, count(*) AS n FROM k GROUP BY 1)
SELECT bucket, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h""")
def bucket_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ordering.bucket_histogram(_keys(spark, sf_dir), "key", 18)
    return ordering.prefix_sum(h, "n", ["bucket"], "start").select("bucket", "n", "start")


@query("bucket_histogram", f"SELECT key >> 16 AS bucket, count(*) AS n FROM ({KEYS_SQL}) GROUP BY 1")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.bucket_histogram(_keys(spark, sf_dir), "key", 16)


@query("bucket_sort_rank", f"SELECT line, key, rank() OVER (ORDER BY key) - 1 AS rank FROM ({KEYS_SQL})")
def bucket_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.global_rank(_keys(spark, sf_dir), "key").select("line", "key", "rank")


@query("row_position", f"SELECT line, row_number() OVER (ORDER BY key, line) - 1 AS position FROM ({KEYS_SQL})")
def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.row_positions(_keys(spark, sf_dir), ["key", "line"]).select("line", "position")


@query("sortedness_violations", f"""SELECT count(*) AS violations, min(line) AS first_line FROM (SELECT line, key, lag(key) OVER (ORDER BY line, key) AS p FROM ({KEYS_SQL})) WHERE p > key""")
def sortedness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines in their own order: many; the same check of the sorted lines gives none (a test)."""
    v = ordering.sortedness_violations(_keys(spark, sf_dir), "line", "key")
    return v.agg(F.count(F.lit(1)).alias("violations"), F.min("line").alias("first_line"))


@query("sorted_has_no_violations", "SELECT 0::BIGINT AS violations")
def sorted_has_no_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ordering.row_positions(_keys(spark, sf_dir), ["key", "line"])
    return ordering.sortedness_violations(placed, "position", "key").agg(F.count(F.lit(1)).alias("violations"))


@query("global_sort_payload", f"SELECT bucket, min(key) AS lo, max(key) AS hi, count(*) AS n FROM (SELECT key, key // 1000000 AS bucket FROM ({KEYS_SQL})) GROUP BY bucket")
def global_sort_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket sort with its payload; buckets of the sorted output are summarised so that rows can be compared."""
    s = ordering.bucket_sort(_keys(spark, sf_dir), ["key", "line"], 8)
    return s.groupBy(F.floor(F.col("key") / 1000000).alias("bucket")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("top_1_degree", f"WITH {EDGES_CTE} SELECT src, count(*) AS degree FROM edges GROUP BY src ORDER BY degree DESC, src LIMIT 1")
def top_1_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "src").limit(1)


@query("adjacency_sorted", f"WITH {EDGES_CTE} SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, dst FROM edges")
def adjacency_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrstone.operators.graph import adjacency

    return adjacency(edges(spark, sf_dir)).select(F.col("id").alias("src"), F.posexplode("neighbours").alias("k", "dst"))


@query("views_by_popcount", "SELECT v AS view, bit_count(v::INTEGER) AS dims FROM range(1, 32) t(v) ORDER BY dims, v")
def views_by_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 32).select(F.col("id").alias("view"), F.bit_count("id").alias("dims")).orderBy("dims", "view")


@query("unsigned_order", f"SELECT line, row_number() OVER (ORDER BY key % 1000, line) AS place FROM ({KEYS_SQL})")
def unsigned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned order of 64-bit keys through the sign-bit flip: keys here are residues with the top bit set."""
    k = _keys(spark, sf_dir).withColumn("u", (F.col("key") % 1000).bitwiseXOR(F.lit(-(1 << 63))))
    biased = k.withColumn("o", F.col("u").bitwiseXOR(F.lit(-(1 << 63))))
    return ordering.row_positions(biased, ["o", "line"], "p").select("line", (F.col("p") + 1).alias("place"))


@query("distinct_set", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("symmetrize", f"WITH {EDGES_CTE} SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def symmetrized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetrize(edges(spark, sf_dir))


@query("set_intersect_choose", f"""WITH {EDGES_CTE}, p AS (SELECT DISTINCT a.src AS a, b.src AS b FROM edges a JOIN edges b ON a.dst = b.dst WHERE a.src < b.src)
SELECT p.a, p.b, count(*) AS common, min(x.dst) AS chosen FROM p JOIN edges x ON x.src = p.a JOIN edges y ON y.src = p.b AND y.dst = x.dst GROUP BY p.a, p.b""")
def set_intersect_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For pairs of vertices with common neighbours: how many, and the least of them as the deterministic pick."""
    return intersect.common_neighbours(lines(spark, sf_dir))


@query("set_membership", f"WITH {EDGES_CTE} SELECT src, count(*) FILTER (dst = 7) AS has_seven, count(DISTINCT CASE WHEN dst = 7 THEN -1 ELSE dst END) + CASE WHEN count(*) FILTER (dst = 7) = 0 THEN 1 ELSE 0 END AS size_with_seven FROM edges GROUP BY src")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrstone.operators.graph import adjacency

    n = adjacency(edges(spark, sf_dir))
    seven = F.array(F.lit(7).cast("long"))
    return n.select(F.col("id").alias("src"), F.array_contains("neighbours", 7).cast("long").alias("has_seven"), F.size(F.array_union("neighbours", seven)).alias("size_with_seven"))


# ---- containers

ARRAY_SQL = "SELECT c_custkey AS idx, CAST(c_nationkey AS BIGINT) AS value FROM customer"


def _array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").cast("long").alias("value"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idx"), (F.col("o_orderkey") % 1000).alias("value"), F.col("o_orderkey").alias("at"))


LAST_WRITE = "SELECT o_custkey AS idx, arg_max(o_orderkey % 1000, o_orderkey) AS w FROM orders GROUP BY o_custkey"


@query("map_upsert", f"SELECT coalesce(a.idx, w.idx) AS idx, coalesce(w.w, a.value) AS value FROM ({ARRAY_SQL}) a FULL JOIN ({LAST_WRITE}) w ON a.idx = w.idx")
def map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.upsert(_array(spark, sf_dir), _writes(spark, sf_dir), ["idx"], "at").select("idx", "value")


@query("map_insert_or_update", f"""SELECT coalesce(a.idx, n.idx) AS idx, CASE WHEN n.k IS NULL THEN a.value WHEN a.value IS NULL THEN 1 ELSE a.value + n.k END AS value
FROM ({ARRAY_SQL}) a FULL JOIN (SELECT o_custkey AS idx, count(*) AS k FROM orders GROUP BY 1) n ON a.idx = n.idx""")
def map_insert_or_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.insert_or_update(_array(spark, sf_dir), _writes(spark, sf_dir).select("idx"), "idx", "value", F.lit(1).cast("long"), lambda old, k: old + k)


@query("map_lookup", f"SELECT idx, value FROM ({ARRAY_SQL}) WHERE idx IN (SELECT o_custkey FROM orders WHERE o_orderkey % 100 = 0)")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_custkey").alias("idx")).distinct()
    return containers.read_at(_array(spark, sf_dir), wanted).select("idx", "value")


@query("vector_push", """SELECT s_suppkey - 1 AS idx, s_suppkey * 7 AS value FROM supplier
UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) - 1 + row_number() OVER (ORDER BY n_nationkey), n_nationkey + 100 FROM nation""")
def vector_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("idx"), (F.col("s_suppkey") * 7).alias("value"))
    more = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 100).cast("long").alias("value"))
    return containers.push(v, more, ["n_nationkey"])


@query("vector_pop_dequeue", """SELECT 'popped' AS what, idx, value FROM (SELECT n_nationkey AS idx, n_regionkey AS value FROM nation) WHERE idx > 21
UNION ALL SELECT 'dequeued', n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 4""")
def vector_pop_dequeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("value"))
    popped, rest = containers.pop(v, 3)
    head, _ = containers.dequeue(rest, 4)
    return popped.select(F.lit("popped").alias("what"), "idx", "value").union(head.select(F.lit("dequeued"), "idx", "value"))


@query("array_fill_copy", f"SELECT idx, 42::BIGINT AS filled, value AS copied FROM ({ARRAY_SQL})")
def array_fill_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _array(spark, sf_dir).select("idx", F.lit(42).cast("long").alias("filled"), F.col("value").alias("copied"))


@query("array_random_write", f"SELECT a.idx, coalesce(w.w, a.value) AS value FROM ({ARRAY_SQL}) a LEFT JOIN ({LAST_WRITE}) w ON a.idx = w.idx")
def array_random_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.write_at(_array(spark, sf_dir), _writes(spark, sf_dir), "at")


@query("array_fetch_add", f"""SELECT o_custkey AS idx, o_orderkey AS at, 2::BIGINT AS amount, value + 2 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS found
FROM orders JOIN ({ARRAY_SQL}) ON o_custkey = idx""")
def array_fetch_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    adds = _writes(spark, sf_dir).select("idx", "at", F.lit(2).cast("long").alias("amount"))
    return containers.fetch_and_add(_array(spark, sf_dir), adds, ["at"])


@query("array_compare_swap", f"SELECT idx, CASE WHEN value = idx % 25 THEN -1 ELSE value END AS value FROM ({ARRAY_SQL})")
def array_compare_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _array(spark, sf_dir)
    return containers.compare_and_swap(a, a.select("idx", (F.col("idx") % 25).alias("expected"), F.lit(-1).cast("long").alias("value")))


@query("unique_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.row_positions(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "id")


SCATTER_SQL = "SELECT i AS idx, {} AS value FROM range(1024) t(i) LEFT JOIN (SELECT (l_partkey * 31 + l_suppkey) % 1024 AS j, l_orderkey AS k FROM lineitem) ON i = j GROUP BY i"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1024).alias("idx"), F.col("l_orderkey").alias("i"))


@query("scatter_increment", SCATTER_SQL.format("count(k)"))
def scatter_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.scatter(1024, _targets(spark, sf_dir), F.count(F.lit(1)))


@query("scatter_xor", SCATTER_SQL.format("coalesce(bit_xor(k), 0)"))
def scatter_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.scatter(1024, _targets(spark, sf_dir), F.bit_xor("i"))


@query("buffer_collect", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def buffer_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(ids, ",").alias("orders"))


@query("named_results", "SELECT 'orders' AS name, count(*) AS value FROM orders UNION ALL SELECT 'parts', count(*) FROM part")
def named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("value")) for n, t in (("orders", "orders"), ("parts", "part"))]
    return parts[0].union(parts[1])


@query("scan_lag", "SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events")
def scan_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))
