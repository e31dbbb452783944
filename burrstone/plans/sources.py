"""Queries over readers, writers and generators: round trips against the edges they started from, and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.plans.edges import EDGES_CTE, edges
from burrstone.plans.graphs import weighted
from burrstone.registry import query
from burrstone.session import cut, table
from burrstone.sources import files
from burrstone.sources import generators as gen

EDGES_SQL = f"WITH {EDGES_CTE} SELECT src, dst FROM edges"
WEIGHTS_SQL = f"WITH {EDGES_CTE} SELECT src AS i, dst AS j, CAST(1 + (src * 31 + dst * 17) % 10 AS DOUBLE) AS v FROM edges"


def _roundtrip(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    path = files.scratch(spark, fmt)
    files.save_edges(edges(spark, sf_dir), path, fmt)
    return files.load_edges(spark, path, fmt)


@query("edges_roundtrip_tsv", EDGES_SQL)
def edges_roundtrip_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "tsv")


@query("edges_roundtrip_bintsv4", EDGES_SQL)
def edges_roundtrip_bintsv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "bintsv4")


@query("edges_roundtrip_mm", EDGES_SQL)
def edges_roundtrip_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "mm")


@query("edges_convert", EDGES_SQL)
def edges_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = files.scratch(spark, "a"), files.scratch(spark, "b")
    files.save_edges(edges(spark, sf_dir), a, "tsv")
    files.convert_edges(spark, a, "tsv", b, "bintsv4")
    return files.load_edges(spark, b, "bintsv4")


@query("text_whitespace_rows", WEIGHTS_SQL)
def text_whitespace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "words")
    e = weighted(edges(spark, sf_dir))
    e.select(F.concat(F.lit(" "), "src", F.lit("  \t"), "dst", F.lit(" "), "weight").alias("value")).write.text(path)
    return files.read_words(spark, path, [("i", "long"), ("j", "long"), ("v", "double")])


@query("binary_rows", "SELECT o_orderkey AS f0, o_custkey AS f1, o_orderkey % 7 AS f2 FROM orders")
def binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "rows")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("f0"), F.col("o_custkey").alias("f1"), (F.col("o_orderkey") % 7).alias("f2"))
    files.write_packed(o, path)
    return files.read_packed(spark, path, ["f0", "f1", "f2"])


@query("binary_doubles", "SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem")
def binary_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "doubles")
    files.write_packed(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), path, "double")
    return files.read_packed(spark, path, ["a", "b"], "double")


@query("text_to_binary", "SELECT o_custkey AS c0, o_orderkey % 100 AS c1 FROM orders")
def text_to_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column is burnt, separators are a set."""
    a, b = files.scratch(spark, "text"), files.scratch(spark, "packed")
    table(spark, sf_dir, "orders").select(F.concat_ws(",", F.lit("x"), F.concat_ws("; ", "o_custkey", F.col("o_orderkey") % 100)).alias("value")).write.text(a)
    files.text_to_packed(spark, a, b, 2, ",; ", burn=1)
    return files.read_packed(spark, b, ["c0", "c1"])


@query("schema_sidecar", "SELECT * FROM (VALUES (0::BIGINT, 'src', 'long'), (1, 'dst', 'long'), (2, 'weight', 'double')) t(k, name, type)")
def schema_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "schema")
    files.write_schema(spark, ["src", "dst", "weight"], ["long", "long", "double"], path)
    rows = [(k, n, t) for k, (n, t) in enumerate(files.read_schema(spark, path))]
    return spark.createDataFrame(rows, "k long, name string, type string")


@query("matrix_symmetric", f"WITH {EDGES_CTE}, w AS (SELECT src + 1 AS i, dst + 1 AS j, CAST(1 + (src * 31 + dst * 17) % 10 AS DOUBLE) AS v FROM edges WHERE src > dst) SELECT * FROM w UNION ALL SELECT j, i, v FROM w")
def matrix_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "mm")
    lower = weighted(edges(spark, sf_dir)).where("src > dst").select((F.col("src") + 1).alias("i"), (F.col("dst") + 1).alias("j"), F.col("weight").alias("v"))
    files.write_matrix(lower, path, "symmetric", "lower triangle")
    return files.read_matrix(spark, path)


@query("root_list", f"WITH {EDGES_CTE} SELECT src AS id FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 64")
def root_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "roots")
    files.save_roots(edges(spark, sf_dir), path)
    return files.load_roots(spark, path)


@query("array_pieces", "SELECT c_custkey AS idx, c_nationkey::BIGINT AS value FROM customer")
def array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "array")
    files.write_array(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").cast("long").alias("value")), path, 4)
    return files.read_array(spark, path)


@query("metrics_json", "SELECT event_type AS name, count(*) AS value FROM events GROUP BY event_type")
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "metrics")
    files.write_metrics(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value")), path)
    return spark.read.schema("name string, value long").json(path)


@query("insert_or_ignore", "SELECT l_orderkey, min(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from burrstone.operators.reduce import keep_first

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    path = files.scratch(spark, "kept")
    keep_first(li, ["l_orderkey"], ["l_linenumber"]).write.parquet(path)
    return spark.read.parquet(path)


@query("gen_mesh", "SELECT i AS src, i + 1 AS dst FROM range(60) t(i) WHERE i % 10 < 9 UNION ALL SELECT i, i + 10 FROM range(50) t(i)")
def gen_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.mesh(spark, 6, 10)


@query("gen_tree", "SELECT (i - 1) // 3 AS src, i AS dst FROM range(1, 500) t(i)")
def gen_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.balanced_tree(spark, 500, 3)


@query("gen_complete", "SELECT a.i AS src, b.i AS dst FROM range(20) a(i), range(20) b(i) WHERE a.i <> b.i")
def gen_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.complete(spark, 20)


def _power_law(e: DataFrame, scale: int) -> DataFrame:
    """Edge count, ids in range, and whether the busiest sixteenth of the ids has over a quarter of the edges."""
    e = cut(e)
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d"), "src").limit((1 << scale) // 16)
    top = d.agg(F.sum("d").alias("top"))
    return e.agg(
        F.count(F.lit(1)).alias("edges"), (F.min(F.least("src", "dst")) >= 0).alias("low_ok"), (F.max(F.greatest("src", "dst")) < 1 << scale).alias("high_ok")
    ).crossJoin(top).select("edges", "low_ok", "high_ok", (F.col("top") * 4 > F.col("edges")).alias("skewed"))


@query("gen_kronecker", "SELECT 16384::BIGINT AS edges, true AS low_ok, true AS high_ok, true AS skewed")
def gen_kronecker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power_law(gen.kronecker(spark, 10, 16 << 10), 10)


@query("gen_rmat", "SELECT 8192::BIGINT AS edges, true AS low_ok, true AS high_ok, true AS skewed")
def gen_rmat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power_law(gen.kronecker(spark, 9, 16 << 9, seed=5, noise=0.1), 9)


@query("gen_scramble", "SELECT i AS id FROM range(4096) t(i)")
def gen_scramble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertex permutation meets each id once."""
    return spark.range(4096).select(gen.scramble(F.col("id"), 12, 7).alias("id"))


@query("gen_keys", "SELECT 65536::BIGINT AS n, true AS in_range, true AS mean_ok, true AS narrow")
def gen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-Gaussian keys: in range, mean one half, deviation near 1 / sqrt(48)."""
    k = gen.near_gaussian_keys(spark, 1 << 16, 1 << 11)
    return k.agg(
        F.count(F.lit(1)).alias("n"), ((F.min("key") >= 0) & (F.max("key") < 2048)).alias("in_range"), (F.abs(F.avg("key") / 2048 - 0.5) < 0.01).alias("mean_ok"),
        (F.abs(F.stddev_samp("key") / 2048 - 0.1443) < 0.005).alias("narrow"),
    )


@query("gen_tuples_points", "SELECT 1000::BIGINT AS n, true AS tuples_ok, true AS points_ok")
def gen_tuples_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = gen.tuples(spark, 1000, 2, 50), gen.points(spark, 1000, 4)
    a = t.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("c0") >= 0) & (F.col("c0") < 50) & (F.col("c1") >= 0) & (F.col("c1") < 50)).alias("tuples_ok"))
    return a.crossJoin(p.agg(F.bool_and((F.size("point") == 4) & (F.array_min("point") >= 0) & (F.array_max("point") < 1)).alias("points_ok")))


# The published size of the sample tree of seed 19, four children on average, ten levels.
@query("gen_unbalanced_tree", "SELECT 4130071::BIGINT AS nodes, 3305118::BIGINT AS leaves, 10 AS depth, true AS children_add_up")
def gen_unbalanced_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometric tree of the published sample: its size, its leaves and its depth; every level but the first is as
    large as the inner nodes above it allow."""
    t = gen.unbalanced_tree(spark, 19, b0=4.0, most_depth=10)
    above = t.select((F.col("depth") + 1).alias("depth"), (F.col("nodes") - F.col("leaves")).alias("inner"))
    fits = t.join(above, "depth", "left").agg(F.bool_and(F.col("inner").isNull() | (F.col("nodes") >= F.col("inner"))).alias("children_add_up"))
    return t.agg(F.sum("nodes").alias("nodes"), F.sum("leaves").alias("leaves"), F.max("depth").alias("depth")).crossJoin(fits)


def _walk_sql(n: int) -> str:
    return (
        f"WITH RECURSIVE w(t, a0, a1) AS (SELECT 0::BIGINT, 3::BIGINT, 5::BIGINT UNION ALL SELECT t + 1, (a0 * 2) % 11, (a1 * 3) % 17 FROM w WHERE t < {n - 1}) "
        "SELECT a0, a1, sum(((a0 + 1) * t) % 31415)::BIGINT AS m0 FROM w GROUP BY a0, a1"
    )


@query("gen_cube_tuples", _walk_sql(2000))
def gen_cube_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.cube_tuples(spark, 2000, [(3, 2, 11), (5, 3, 17)], 1).groupBy("a0", "a1").agg(F.sum("m0").alias("m0"))
