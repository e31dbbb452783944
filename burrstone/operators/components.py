"""Connected components over an edge DataFrame by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrstone.session import cut

#: Edges up to this many are joined by union-find in one task.
ONE_TASK = 200_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # Each edge gives its far end and its own node the least of the node.
    ends = F.explode(F.array("v", "u")).alias("u")
    return down.join(least, "u").select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def _in_one_task(e: DataFrame) -> DataFrame:
    """Union-find over the edges (u, v), in one task of an executor; each node with the least id of its component."""
    import pyarrow as pa

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])

    return e.coalesce(1).mapInArrow(run, "u long, v long").where("u <> v")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the least id that each endpoint of an edge can reach; ids on no edge are not listed.

    Every round is two shuffles of the edge list on node ids, cut in the shared checkpoint folder; hubs are met by
    partial aggregation (the minimum) and by skew-join splitting, and no group is ever gathered. Rounds grow with the
    logarithm of the longest path. If at most one_task distinct edges are left, one task of an executor finishes them
    with union-find; the edges are counted, so its memory is bounded. Null endpoints are left out; self-edges list their
    node; edges may repeat.
    """
    given = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna()
    loops = given.where("u = v").select("u").distinct()
    e = cut(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, left = None, e.count()
    for _ in range(most_rounds):
        if left <= one_task:
            e = cut(_in_one_task(e))
            break
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, left = now, now[0]
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("u")).distinct()
    return (
        e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        .union(roots.select("u", "u")).union(loops.select("u", "u"))
        .groupBy("id").agg(F.min("component").alias("component"))
    )
