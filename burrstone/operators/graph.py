"""Graph building, traversal and ranking over edge DataFrames (src, dst[, weight])."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrstone.session import cut


#: Pieces of a growing result that are written again as one piece.
FAN = 8
#: Means that travel as literals of one expression; more of them go to an Arrow function as one array.
LITERAL_MEANS = 64


class Grown:
    """Rows that grow by a written piece each round. FAN pieces of one tier become one piece of the next, so a row is
    written again a logarithmic number of times, and the plan over all pieces stays short however many rounds there are."""

    def __init__(self, first: DataFrame):
        self.tiers = [[first]]

    def add(self, piece: DataFrame) -> None:
        self.tiers[0].append(piece)
        for k, tier in enumerate(self.tiers):
            if len(tier) < FAN:
                break
            if k + 1 == len(self.tiers):
                self.tiers.append([])
            self.tiers[k + 1].append(cut(reduce(DataFrame.unionByName, tier)))
            self.tiers[k] = []

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [piece for tier in self.tiers for piece in tier])


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree of every endpoint, in one aggregation."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select(F.col("dst"), F.lit(0), F.lit(1))
    )
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def build(edges: DataFrame, directed: bool = True, drop_loops: bool = False) -> DataFrame:
    """Distinct edges, both ways if not directed."""
    e = edges.select("src", "dst").where("src <> dst") if drop_loops else edges.select("src", "dst")
    return e.distinct() if directed else symmetrize(e)


def adjacency(edges: DataFrame) -> DataFrame:
    """id and its sorted distinct neighbours."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def csr(edges: DataFrame) -> DataFrame:
    """src, dst and the place of each distinct edge in row order: offset of the row (a prefix sum of degrees) plus rank."""
    from burrstone.operators.ordering import prefix_sum

    e = build(edges)
    rows = prefix_sum(e.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "degree", ["src"], "offset")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    return e.withColumn("__rank", rank).join(rows, "src").select("src", "dst", (F.col("offset") + F.col("__rank")).alias("position"))


def max_degree_root(edges: DataFrame) -> int:
    """The vertex of largest out-degree, the least id of those."""
    return edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]


def bfs(edges: DataFrame, roots: DataFrame, mode: str = "push", alpha: float = 20.0, beta: float = 20.0, most: int = 10_000) -> DataFrame:
    """id, level, parent of what can be reached from the roots (a column id), level by level.

    push joins the frontier with its out-edges; pull joins the unvisited with their in-edges; hybrid pulls once the
    frontier grows and its edges are more than the remaining edges / alpha, and goes back once it shrinks and has fewer
    than n / beta vertices.
    The parent is the least frontier neighbour, so results do not depend on the mode or on timing.
    """
    if mode not in ("push", "pull", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    edges = cut(edges.select("src", "dst").distinct())
    everything = cut(degrees(edges).select("id", F.col("out_degree").alias("d")))
    n, remaining = everything.agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
    start = cut(roots.select(F.col("id").cast("long")).distinct().join(everything, "id", "left").select(
        "id", F.lit(0).alias("level"), F.col("id").alias("parent"), F.coalesce("d", F.lit(0).cast("long")).alias("d")
    ))
    seen, frontier, level, pulling, last = Grown(start), start, 0, mode == "pull", 0
    while level < most:
        size, weight = frontier.agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
        if not size:
            break
        remaining -= weight
        if mode == "hybrid":
            if not pulling and size > last and weight > max(1, remaining) / alpha:
                pulling = True
            elif pulling and size < last and size < n / beta:
                pulling = False
        last = size
        f, known = frontier.select(F.col("id").alias("src")), seen.rows().select("id")
        if pulling:
            hit = everything.join(known, "id", "left_anti").join(edges.withColumnRenamed("dst", "id"), "id").join(f, "src", "left_semi")
            new = hit.groupBy("id").agg(F.min("src").alias("parent"), F.first("d").alias("d"))
        else:  # one row for each vertex that is hit before it meets what is known
            hit = f.join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
            new = hit.join(known, "id", "left_anti").join(everything, "id")
        level += 1
        frontier = cut(new.select("id", F.lit(level).alias("level"), "parent", "d"))
        seen.add(frontier)
    return cut(seen.rows().select("id", "level", "parent"))


def bfs_violations(edges: DataFrame, tree: DataFrame, root: int) -> DataFrame:
    """Rows that break the rules of a search tree over undirected edges: none if it is right."""
    a, b = tree.select(F.col("id").alias("src"), F.col("level").alias("ls")), tree.select(F.col("id").alias("dst"), F.col("level").alias("ld"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    one_sided = joined.where(F.col("ls").isNull() != F.col("ld").isNull()).select(F.lit("one endpoint").alias("rule"), F.col("src").alias("id"))
    far = joined.where(F.abs(F.col("ls") - F.col("ld")) > 1).select(F.lit("level gap"), F.col("src"))
    own = tree.where((F.col("id") == F.col("parent")) != (F.col("id") == root)).select(F.lit("own parent"), F.col("id"))
    up = tree.where(F.col("id") != root).select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    no_edge = up.join(edges, ["src", "dst"], "left_anti").select(F.lit("no such edge"), F.col("dst"))
    return one_sided.union(far).union(own).union(no_edge)


def traversed_edges(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges with both ends in a search tree, as one row."""
    ids = tree.select("id")
    held = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held.agg(F.count(F.lit(1)).alias("traversed"))


def sssp(edges: DataFrame, root: int, most: int = 10_000) -> DataFrame:
    """id, dist, parent by Bellman-Ford; only vertices whose distance fell send in the next round. Ties take the least parent."""
    edges = cut(edges.select("src", "dst", "weight"))
    spark = edges.sparkSession
    start = spark.range(root, root + 1).select("id", F.lit(0.0).alias("dist"), F.col("id").alias("parent"))
    active = cut(start)
    known = Grown(active)
    best = F.min(F.struct("dist", "parent")).alias("best")
    for _ in range(most):
        sent = active.select(F.col("id").alias("src"), F.col("dist").alias("ds")).join(edges, "src").select(
            F.col("dst").alias("id"), (F.col("ds") + F.col("weight")).alias("dist"), F.col("src").alias("parent")
        ).groupBy("id").agg(best).select("id", "best.*")
        # A vertex has a row for each time its distance fell, and the least of them is the last.
        old = known.rows().groupBy("id").agg(F.min("dist").alias("old"))
        active = cut(sent.join(old, "id", "left").where(F.col("old").isNull() | (F.col("dist") < F.col("old"))).select("id", "dist", "parent"))
        if active.isEmpty():
            break
        known.add(active)
    return cut(known.rows().groupBy("id").agg(best).select("id", "best.*"))


def sssp_violations(edges: DataFrame, tree: DataFrame, root: int) -> DataFrame:
    """Edges that could still be relaxed and children whose distance is not the parent's plus an edge's weight."""
    d = tree.select("id", "dist")
    ends = edges.join(d.withColumnRenamed("id", "src").withColumnRenamed("dist", "ds"), "src").join(
        d.withColumnRenamed("id", "dst").withColumnRenamed("dist", "dd"), "dst", "left"
    )
    loose = ends.where(F.col("dd").isNull() | (F.col("dd") > F.col("ds") + F.col("weight"))).select(F.lit("relaxable").alias("rule"), F.col("dst").alias("id"))
    fits = ends.where(F.col("dd") == F.col("ds") + F.col("weight")).select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    wrong = tree.where(F.col("id") != root).join(fits, ["id", "parent"], "left_anti").select(F.lit("parent distance"), F.col("id"))
    return loose.union(wrong)


def min_label(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, component) by the least label that neighbours send, with pointer jumping; only changed labels send again.

    A label may be that of most vertices. Such labels are counted: those with more than an even share of a shuffle
    partition are at most as many as partitions, so they are broadcast, and only the other labels are shuffled."""
    e = cut(symmetrize(edges))
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = cut(e.groupBy(F.col("src").alias("id")).agg(F.least(F.min("src"), F.min("dst")).alias("component")))
    n, active = labels.count(), labels
    for _ in range(most):
        sent = active.select(F.col("id").alias("src"), "component").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("m"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("jumped"))
        hot = cut(labels.groupBy("component").count().where(F.col("count") * parts > n).join(jump, "component").select("component", "jumped"))
        marked = labels.join(sent, "id", "left").join(F.broadcast(hot), "component", "left")
        cold = marked.where(F.col("jumped").isNull()).drop("jumped").join(jump, "component", "left")
        new = cut(
            marked.where(F.col("jumped").isNotNull()).unionByName(cold)
            .select("id", F.col("component").alias("old"), F.least("component", "m", "jumped").alias("component"))
        )
        active = new.where("component < old").select("id", "component")
        labels = new.select("id", "component")
        if active.isEmpty():
            break
    return labels


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """id, rank after some rounds of rank = (1 - damping) + damping * sum of rank / out-degree. A vertex without
    out-edges gives nothing."""
    e = cut(edges.select("src", "dst"))
    vertices = cut(degrees(e).select("id", "out_degree"))
    ranks = vertices.select("id", "out_degree", F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        given = ranks.where("out_degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share"))
        got = given.join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        ranks = cut(vertices.join(got, "id", "left").select("id", "out_degree", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks.select("id", "rank")


def pagerank_delta(edges: DataFrame, tolerance: float = 1e-2, damping: float = 0.85, most: int = 1024) -> DataFrame:
    """id, rank after at most so many rounds from ranks of 1, and one at least. In the first every vertex gathers; after
    it a vertex sends the change of its rank while that is above the tolerance, as the delta-cached form does. At a
    tolerance of 0 every change is sent, so the ranks are those of pagerank() after as many rounds.

    A vertex without in-edges falls to 1 - damping in the first round and never changes again. What it sends in the first
    two rounds is summed once for each target; only edges of other vertices are written and met in every round."""
    vertices = cut(degrees(edges))
    given = edges.join(vertices.select(F.col("id").alias("src"), "out_degree", "in_degree"), "src")
    e = cut(given.where("in_degree > 0").select("src", "dst"))
    once = given.where("in_degree = 0").groupBy(F.col("dst").alias("id")).agg(F.sum(F.lit(1.0) / F.col("out_degree")).alias("once"))
    state = cut(vertices.where("in_degree > 0").join(once, "id", "left").select(
        "id", "out_degree", F.coalesce("once", F.lit(0.0)).alias("once"), F.lit(1 - damping).alias("rank"), F.lit(1.0).alias("delta")
    ))
    for k in range(max(1, most)):
        # The first round sends ranks of 1, which leaves their change to what is gathered; the second that of 1 - damping to 1.
        sends = (F.col("out_degree") > 0) & ((F.abs("delta") > tolerance) | F.lit(k == 0))
        from_once = damping if k == 0 else -damping * damping if k == 1 and damping > tolerance else 0.0
        sent = state.where(sends).select(F.col("id").alias("src"), (F.lit(damping) * F.col("delta") / F.col("out_degree")).alias("d"))
        if k > 1 and sent.isEmpty():
            break
        got = sent.join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("d").alias("got"))
        more = F.coalesce("got", F.lit(0.0)) + F.lit(from_once) * F.col("once")
        kept = F.when(sends, F.lit(0.0)).otherwise(F.col("delta")) if k else F.lit(-damping)
        state = cut(state.join(got, "id", "left").select(
            "id", "out_degree", "once", (F.col("rank") + more).alias("rank"), (kept + more).alias("delta")
        ))
    still = vertices.where("in_degree = 0").select("id", F.lit(1 - damping).alias("rank"))
    return still.unionByName(state.select("id", "rank"))


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """i, y: rows of the product of matrix (i, j, v) and vector (j, x)."""
    return matrix.join(vector, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def power_iteration(matrix: DataFrame, n_rows: DataFrame, rounds: int, damping: float = 0.8, epsilon: float = 0.0) -> DataFrame:
    """id, x: x <- normalised (damping * M x + (1 - damping) / n) from the even vector, until the change is small."""
    m = cut(matrix)
    ids = cut(n_rows.select("id").distinct())
    n = ids.count()
    x = ids.select("id", F.lit(1.0 / n**0.5).alias("x"))
    for _ in range(rounds):
        y = spmv(m, x.select(F.col("id").alias("j"), "x"))
        raw = ids.join(y.withColumnRenamed("i", "id"), "id", "left").select("id", (F.lit(damping) * F.coalesce("y", F.lit(0.0)) + F.lit((1 - damping) / n)).alias("r"))
        norm = raw.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
        new = cut(raw.crossJoin(F.broadcast(norm)).select("id", (F.col("r") / F.col("norm")).alias("x")))
        if epsilon:
            gap = new.join(x.withColumnRenamed("x", "o"), "id").agg(F.sqrt(F.sum((F.col("x") - F.col("o")) ** 2))).first()[0]
            if gap <= epsilon:
                return new
        x = new
    return x


@dataclass
class VertexProgram:
    """Gather, apply and scatter as expressions.

    init(id) gives the value of a vertex and whether it starts active. message(value, edge columns) is what an active
    vertex sends along an out-edge; combine folds messages of a vertex. apply(old, message) is its new value; it is active
    next if changed(old, new) holds. Messages carry their source: the least source of the best message is kept.
    """

    init: Callable[[Column], tuple[Column, Column]]
    message: Callable[[Column], Column]
    combine: Callable[[Column], Column]
    apply: Callable[[Column, Column], Column]
    changed: Callable[[Column, Column], Column]


def run_program(edges: DataFrame, program: VertexProgram, most: int = 1024) -> DataFrame:
    """id, value after no vertex is active or most rounds. Only active vertices send."""
    e = cut(edges)
    value, active = program.init(F.col("id"))
    state = cut(endpoints(e.select("src", "dst")).select("id", value.alias("value"), active.alias("active")))
    for _ in range(most):
        senders = state.where("active").select(F.col("id").alias("src"), "value")
        if senders.isEmpty():
            break
        got = senders.join(e, "src").groupBy(F.col("dst").alias("id")).agg(program.combine(program.message(F.col("value"))).alias("m"))
        new = F.when(F.col("m").isNull(), F.col("value")).otherwise(program.apply(F.col("value"), F.col("m")))
        state = cut(state.join(got, "id", "left").select("id", new.alias("value"), F.coalesce(F.col("m").isNotNull() & program.changed(F.col("value"), new), F.lit(False)).alias("active")))
    return state.select("id", "value")


def colored_paths(edges: DataFrame, colors: DataFrame, pattern: Sequence[int]) -> DataFrame:
    """One row with the number of simple paths whose vertices have the colours of the pattern in turn."""
    colored = lambda c, name: colors.where(F.col("color") == c).select(F.col("id").alias(name))
    paths = colored(pattern[0], "v0")
    for k in range(1, len(pattern)):
        step = edges.select(F.col("src").alias(f"v{k - 1}"), F.col("dst").alias(f"v{k}")).join(colored(pattern[k], f"v{k}"), f"v{k}", "left_semi")
        paths = paths.join(step, f"v{k - 1}")
        for i in range(k):
            if pattern[i] == pattern[k]:
                paths = paths.where(F.col(f"v{i}") != F.col(f"v{k}"))
    return paths.agg(F.count(F.lit(1)).alias("paths"))


def tree_search(tree: DataFrame, root: int, color: Column, wanted: int) -> DataFrame:
    """Ids in the subtree of a root (tree has parent, child) whose colour, an expression of id, is the wanted one."""
    t = cut(tree.select("parent", "child"))
    level = t.sparkSession.range(root, root + 1).select("id")
    found = level
    while True:
        level = cut(level.join(t, F.col("id") == F.col("parent")).select(F.col("child").alias("id")))
        if level.isEmpty():
            break
        found = found.union(level)
    return found.where(color == wanted)


def n_queens(spark, n: int) -> DataFrame:
    """One row with the number of ways to place n queens; partial boards grow a row at a time."""
    boards = spark.range(1).select(F.array().cast("array<int>").alias("b"))
    for row in range(n):
        boards = boards.select("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"))
        safe = F.forall(F.sequence(F.lit(0), F.lit(row - 1)), lambda i: (F.element_at("b", i + 1) != F.col("c")) & (F.abs(F.element_at("b", i + 1) - F.col("c")) != row - i)) if row else F.lit(True)
        boards = boards.where(safe).select(F.concat("b", F.array("c")).alias("b"))
    return boards.agg(F.count(F.lit(1)).alias("solutions"))


def normalised(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Each dimension divided by its sum over all points; a dimension whose sum is zero or null stays as it is."""
    sums = points.agg(*[F.sum(d).alias(f"__sum_{d}") for d in dims])
    scaled = {d: F.when(F.col(f"__sum_{d}") != 0, F.col(d) / F.col(f"__sum_{d}")).otherwise(F.col(d)) for d in dims}
    return points.crossJoin(F.broadcast(sums)).withColumns(scaled).drop(*[f"__sum_{d}" for d in dims])


def kmeans(
    points: DataFrame, dims: Sequence[str], start: Sequence[Sequence[float]], rounds: int, tolerance: float | None = None,
    fraction: float | None = None, seed: int = 0,
) -> list[list[float]]:
    """Lloyd's means from given ones. The means are k short rows, so they travel with the expression; sums and counts are
    combined before the shuffle, and only k rows come back. A mean without points stays; ties go to the first mean.

    Stops after some rounds, or once the squared moves of all means sum up to at most the tolerance. With a fraction each
    round takes another random share of the points, which is the sampled form of the operator."""
    points = cut(points.select(*dims))
    means = [list(map(float, m)) for m in start]
    for k in range(rounds):
        taken = points if fraction is None else points.sample(fraction, seed + k)
        rows = taken.groupBy(nearest_mean(dims, means).alias("m")).agg(*[F.avg(d).alias(d) for d in dims]).collect()
        new = [list(m) for m in means]
        for r in rows:
            new[r["m"]] = [float(r[d]) for d in dims]
        moved = sum((a - b) ** 2 for x, y in zip(new, means, strict=True) for a, b in zip(x, y, strict=True))
        means = new
        if tolerance is not None and moved <= tolerance:
            break
    return means


def nearest_mean(dims: Sequence[str], means: Sequence[Sequence[float]]) -> Column:
    """The number of the nearest mean by squared distance. Both forms add the dimensions in one order, so they agree."""
    if len(means) > LITERAL_MEANS:
        return _nearest_of_many(dims, means)
    distances = []
    for k, m in enumerate(means):
        d = None
        for name, v in zip(dims, m, strict=True):
            term = (F.col(name) - F.lit(v)) * (F.col(name) - F.lit(v))
            d = term if d is None else d + term
        distances.append(F.struct(d.alias("d"), F.lit(k).alias("k")))
    return F.array_min(F.array(*distances))["k"]


def _nearest_of_many(dims: Sequence[str], means: Sequence[Sequence[float]]) -> Column:
    at = np.array(means, float)

    @F.pandas_udf("int")
    def nearest(point: pd.DataFrame) -> pd.Series:
        x, out = point.to_numpy(float), np.empty(len(point), "i4")
        for i in range(0, len(x), 1024):
            d = np.zeros((len(x[i : i + 1024]), len(at)))
            for j in range(at.shape[1]):
                d += (x[i : i + 1024, j, None] - at[None, :, j]) ** 2
            out[i : i + 1024] = d.argmin(1)
        return pd.Series(out)

    return nearest(F.struct(*[F.col(d).cast("double").alias(f"c{i}") for i, d in enumerate(dims)]))
