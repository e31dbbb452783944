"""Subgraph-pattern queries: triangles, two-hop pairs and squares under several plan shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.operators import hypercube, metrics
from burrstone.plans.edges import EDGES_CTE, edges
from burrstone.registry import query, run_query

TRIANGLES_SQL = (
    f"WITH {EDGES_CTE} SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src "
    "JOIN edges c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.dst < b.dst"
)
TWOHOP_SQL = f"WITH {EDGES_CTE} SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src"
SQUARES_SQL = (
    f"WITH {EDGES_CTE} SELECT count(*) AS squares FROM edges e1 JOIN edges e2 ON e1.dst = e2.src "
    "JOIN edges e3 ON e2.dst = e3.src JOIN edges e4 ON e3.dst = e4.src AND e4.dst = e1.src"
)


def named(e: DataFrame, a: str, b: str) -> DataFrame:
    return e.select(F.col("src").alias(a), F.col("dst").alias(b))


def triangles(e: DataFrame, watch: metrics.Metrics | None = None) -> DataFrame:
    """Left-deep listing of x < y < z with edges x-y, y-z, z-x; both order tests run before the closing join. Metrics
    count the rows of each step while the plan runs."""
    step = lambda df, name: watch.watch(df, **{name: (metrics.total, F.lit(1))}) if watch else df
    xy, yz = step(named(e, "x", "y").where("x < y"), "chosen"), named(e, "y", "z").where("y < z")
    paths = step(xy.join(yz, "y"), "paths")
    return step(paths.join(named(e, "z", "x"), ["z", "x"]).select("x", "y", "z"), "triangles")


def triangles_hypercube(e: DataFrame, sizes: list[int]) -> DataFrame:
    """The same in one round on axes (x, y, z). Relations carry their roles, so each triangle is found in one cell."""
    return hypercube.cell_join([
        (named(e, "x", "y").where("x < y"), ["x", "y", None]),
        (named(e, "y", "z").where("y < z"), [None, "y", "z"]),
        (named(e, "z", "x").where("x < z"), ["x", None, "z"]),
    ], sizes).select("x", "y", "z")


def square_parts(e: DataFrame) -> list[DataFrame]:
    return [named(e, "a", "b"), named(e, "b", "c"), named(e, "c", "d"), named(e, "d", "a")]


def squares_leftdeep(e: DataFrame) -> DataFrame:
    r = square_parts(e)
    return r[0].join(r[1], "b").join(r[2], "c").join(r[3], ["d", "a"])


def squares_bushy(e: DataFrame) -> DataFrame:
    r = square_parts(e)
    return r[0].join(r[1], "b").join(r[2].join(r[3], "d"), ["a", "c"])


def squares_hypercube(e: DataFrame, sizes: list[int], bushy: bool = False) -> DataFrame:
    """One round on axes (a, b, c, d), then a left-deep or a bushy plan inside each cell."""
    r = square_parts(e)
    axes = [["a", "b", None, None], [None, "b", "c", None], [None, None, "c", "d"], ["a", None, None, "d"]]
    plan = (lambda h: h[0].join(h[1], ["cell", "b"]).join(h[2].join(h[3], ["cell", "d"]), ["cell", "a", "c"])) if bushy else None
    return hypercube.cell_join(list(zip(r, axes, strict=True)), sizes, plan)


def counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


@query("tri_leftdeep", TRIANGLES_SQL)
def tri_leftdeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(edges(spark, sf_dir))


@query("tri_counters", f"""WITH {EDGES_CTE}, p AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src < a.dst AND b.src < b.dst)
SELECT name, n FROM (SELECT 'chosen' AS name, count(*) AS n FROM edges WHERE src < dst UNION ALL SELECT 'paths', count(*) FROM p
UNION ALL SELECT 'triangles', count(*) FROM p JOIN edges c ON c.src = p.z AND c.dst = p.x)""")
def tri_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the intermediate results of the listing, gathered by one run of it."""
    ran = run_query(lambda: edges(spark, sf_dir), triangles)
    return spark.createDataFrame([(k, ran.counters[k] or 0) for k in ("chosen", "paths", "triangles")], "name string, n long")


@query("tri_sql", TRIANGLES_SQL)
def tri_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT a.src AS x, a.dst AS y, b.dst AS z FROM {e} a, {e} b, {e} c "
        "WHERE a.dst = b.src AND b.dst = c.src AND c.dst = a.src AND a.src < a.dst AND a.dst < b.dst",
        e=edges(spark, sf_dir),
    )


@query("tri_hypercube", TRIANGLES_SQL)
def tri_hypercube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles_hypercube(edges(spark, sf_dir), hypercube.shares(8, 3))


@query("tri_degree_order", f"""WITH {EDGES_CTE}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
d AS (SELECT src AS id, count(*) AS n FROM u GROUP BY src),
o AS (SELECT u.src, u.dst FROM u JOIN d a ON u.src = a.id JOIN d b ON u.dst = b.id WHERE (a.n, a.id) < (b.n, b.id))
SELECT count(*) AS triangles FROM o a JOIN o b ON a.dst = b.src JOIN o c ON c.src = a.src AND c.dst = b.dst""")
def tri_degree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected triangles with edges turned towards the larger (degree, id): no tie is lost, hubs send little."""
    from burrstone.operators.graph import symmetrize

    u = symmetrize(edges(spark, sf_dir))
    d = u.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    o = (
        u.join(d.select(F.col("src"), F.col("n").alias("ns")), "src").join(d.select(F.col("src").alias("dst"), F.col("n").alias("nd")), "dst")
        .where(F.struct("ns", "src") < F.struct(F.col("nd").alias("ns"), F.col("dst").alias("src"))).select("src", "dst")
    )
    return counted(named(o, "x", "y").join(named(o, "y", "z"), "y").join(named(o, "x", "z"), ["x", "z"]), "triangles")


@query("twohop_distinct", TWOHOP_SQL)
def twohop_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return named(e, "src", "y").join(named(e, "y", "dst"), "y").select("src", "dst").distinct()


@query("chain_join", f"WITH {EDGES_CTE} SELECT a.src AS v0, b.src AS v1, c.src AS v2, c.dst AS v3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src")
def chain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return named(e, "v0", "v1").join(named(e, "v1", "v2"), "v1").join(named(e, "v2", "v3"), "v2").select("v0", "v1", "v2", "v3")


@query("square_leftdeep", SQUARES_SQL)
def square_leftdeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(squares_leftdeep(edges(spark, sf_dir)), "squares")


@query("square_bushy", SQUARES_SQL)
def square_bushy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(squares_bushy(edges(spark, sf_dir)), "squares")


@query("square_hypercube", SQUARES_SQL)
def square_hypercube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(squares_hypercube(edges(spark, sf_dir), hypercube.shares(16, 4)), "squares")


@query("square_hypercube_bushy", SQUARES_SQL)
def square_hypercube_bushy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(squares_hypercube(edges(spark, sf_dir), hypercube.shares(16, 4), bushy=True), "squares")


@query("square_semijoin", f"""WITH {EDGES_CTE}, ac AS (SELECT DISTINCT e1.src AS a, e2.dst AS c FROM edges e1 JOIN edges e2 ON e1.dst = e2.src)
SELECT count(*) AS matches FROM edges e3 JOIN edges e4 ON e3.dst = e4.src JOIN ac ON ac.a = e4.dst AND ac.c = e3.src""")
def square_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = square_parts(edges(spark, sf_dir))
    return counted(r[2].join(r[3], "d").join(r[0].join(r[1], "b"), ["a", "c"], "left_semi"), "matches")


@query("hypercube_slice", "SELECT s AS serial, s // 9 AS x, (s // 3) % 3 AS y, s % 3 AS z FROM range(27) t(s) WHERE (s // 3) % 3 = 1")
def hypercube_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = hypercube.Hypercube([3, 3, 3])
    rows = [(s, s // 9, s // 3 % 3, s % 3) for s in cube.slice([None, 1, None])]
    return spark.createDataFrame(rows, "serial long, x long, y long, z long")
