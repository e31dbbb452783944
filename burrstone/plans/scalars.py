"""Scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone import functions as fn
from burrstone.registry import query
from burrstone.session import table


@query("fn_split", "SELECT p_partkey, len(string_split(p_name, ' ')) AS pieces, string_split(p_name, ' ')[1] AS first_piece FROM part")
def fn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fn.split_keep(F.col("p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(s).alias("pieces"), F.element_at(s, 1).alias("first_piece"))


@query("fn_tokens", r"""SELECT event_id, len(t) AS n, t[1] AS first_token FROM (SELECT event_id, list_filter(regexp_split_to_array(props, '[{}": ,]+'), lambda x: x <> '') AS t FROM events)""")
def fn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fn.tokens(F.col("props"), '{}": ,')
    return table(spark, sf_dir, "events").select("event_id", F.size(t).alias("n"), F.element_at(t, 1).alias("first_token"))


@query("fn_parse", r"SELECT event_id, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k, CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) / 2 AS half FROM events")
def fn_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.regexp_extract("props", r"(\d+)", 1)
    return table(spark, sf_dir, "events").select("event_id", fn.parse_int(digits).alias("k"), (fn.parse_double(digits) / 2).alias("half"))


@query("fn_bits", """SELECT l_orderkey, l_linenumber, l_orderkey >> 3 AS high, xor(l_orderkey, l_partkey) AS mixed, l_partkey & 255 AS low, bit_count(l_partkey) AS ones FROM lineitem""")
def fn_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.shiftright("l_orderkey", 3).alias("high"), F.col("l_orderkey").bitwiseXOR(F.col("l_partkey")).alias("mixed"),
        F.col("l_partkey").bitwiseAND(F.lit(255)).alias("low"), F.bit_count("l_partkey").alias("ones"),
    )


@query("fn_hash_mod", "SELECT l_orderkey, l_linenumber, (l_partkey * 31 + l_suppkey) % 64 AS pair, (l_orderkey * 7 + 3) % 16 AS linear, l_partkey % 5 AS axis, (l_orderkey << 32) | l_partkey AS joined FROM lineitem")
def fn_hash_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.pair_hash(F.col("l_partkey"), F.col("l_suppkey"), 64).alias("pair"),
        F.pmod(F.col("l_orderkey") * 7 + 3, F.lit(16)).alias("linear"), F.pmod("l_partkey", F.lit(5)).alias("axis"),
        fn.pair_concat(F.col("l_orderkey"), F.col("l_partkey")).alias("joined"),
    )


@query("fn_int_root", """SELECT i, (SELECT max(r) FROM range(60) s(r) WHERE r * r * r <= i) AS cube_root, (SELECT max(r) FROM range(60) s(r) WHERE r * r * r * r <= i) AS fourth_root FROM range(3000) t(i)""")
def fn_int_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(3000).select(F.col("id").alias("i"), fn.int_root(F.col("id"), 3).alias("cube_root"), fn.int_root(F.col("id"), 4).alias("fourth_root"))


@query("fn_math", """SELECT c_custkey, round(pow(c_nationkey, 2), 6) AS p, round(sqrt(abs(c_acctbal)), 6) AS s, round(sin(c_custkey), 6) AS sine, round(ln(c_custkey + 1), 6) AS l,
floor(c_acctbal) AS f, round(cbrt(c_custkey), 6) AS c FROM customer""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(F.pow("c_nationkey", F.lit(2)), 6).alias("p"), F.round(F.sqrt(F.abs("c_acctbal")), 6).alias("s"), F.round(F.sin("c_custkey"), 6).alias("sine"),
        F.round(F.log(F.col("c_custkey") + 1), 6).alias("l"), F.floor("c_acctbal").cast("double").alias("f"), F.round(F.cbrt("c_custkey"), 6).alias("c"),
    )


@query("fn_vectors", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT v AS w FROM e WHERE vec_id = 0)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance, round(v[1] + w[1], 6) AS first_sum, round(v[2] * 3, 6) AS scaled, false AS bad FROM e, z""")
def fn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    z = e.where("vec_id = 0").select(F.col("v").alias("w"))
    return e.crossJoin(F.broadcast(z)).select(
        "vec_id", F.round(fn.squared_distance(F.col("v"), F.col("w")), 6).alias("distance"), F.round(F.element_at(fn.vector_add(F.col("v"), F.col("w")), 1), 6).alias("first_sum"),
        F.round(F.element_at(fn.vector_scale(F.col("v"), F.lit(3.0)), 2), 6).alias("scaled"), fn.has_nan(F.col("v")).alias("bad"),
    )


@query("fn_render", "SELECT o_orderkey, '(' || o_orderkey || ', ' || o_custkey || ')' AS tuple_text FROM orders")
def fn_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("("), F.concat_ws(", ", "o_orderkey", "o_custkey"), F.lit(")")).alias("tuple_text"))


@query("fn_random_invariant", "SELECT true AS in_range, true AS near_half, true AS repeatable")
def fn_random_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded uniform numbers: in range, of mean one half, and the same for the same seed."""
    u = lambda: spark.range(0, 20000, 1, 4).select("id", F.rand(11).alias("u"))
    same = u().join(u().withColumnRenamed("u", "v"), "id").agg(F.bool_and(F.col("u") == F.col("v")).alias("repeatable"))
    return u().agg(F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_range"), (F.abs(F.avg("u") - 0.5) < 0.02).alias("near_half")).crossJoin(same)


@query("fn_combinatorics", """SELECT n, k, CAST(factorial(n::INTEGER) / (factorial(k::INTEGER) * factorial((n - k)::INTEGER)) AS BIGINT) AS ways,
(SELECT count(*) FROM range(1, CAST(pow(2, n) AS BIGINT)) m(v) WHERE bit_count(v) = k) AS masks, lcm(n, k) AS period FROM range(1, 11) a(n), range(1, 11) b(k) WHERE k <= n""")
def fn_combinatorics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan-time helpers: binomials, the views of each size among all subsets, and the common period of two walks."""
    rows = []
    for n in range(1, 11):
        views = [len(fn.mask_to_dims(m, n)) for m in fn.subsets(n)]
        rows += [(n, k, fn.choose(n, k), views.count(k), fn.expected_view_size([n, k])) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "n long, k long, ways long, masks long, period long")


@query("forall_lambda", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey // 2 ELSE 3 * o_custkey + 1 END AS next FROM orders")
def forall_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any function over the elements, as users bring it: whole batches in, whole batches out."""
    step = fn.elementwise(lambda x: (x // 2).where(x % 2 == 0, 3 * x + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", step("o_custkey").alias("next"))
