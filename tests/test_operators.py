"""Operators on literal fixtures, with the cases that tables don't have."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burrstone import registry
from burrstone.operators import components as cc
from burrstone.operators import containers, graph, hypercube, intersect, mapreduce, metrics, ordering, reduce
from burrstone.plans import patterns

SMALL = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 2), (4, 5), (5, 1)]
HUB = [(1, r) for r in range(2, 8)] + [(r, 1) for r in range(2, 8)]
RIM = [(2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 2)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def reference_triangles(e):
    s = set(e)
    return sorted((x, y, z) for x, y in s for y2, z in s if y2 == y and x < y < z and (z, x) in s)


@pytest.mark.parametrize("rows", [SMALL, HUB + RIM + [(b, a) for a, b in RIM], [], [(1, 1)], [(3, 2), (2, 1), (1, 3)]])
def test_triangle_plans_agree(spark, rows):
    e = edges(spark, rows)
    want = reference_triangles(rows)
    assert tuples(patterns.triangles(e.distinct())) == want
    for sizes in ([2, 2, 2], [1, 3, 2]):
        assert tuples(patterns.triangles_hypercube(e.distinct(), sizes)) == want


def test_small_triangles(spark):
    assert tuples(patterns.triangles(edges(spark, SMALL))) == [(1, 2, 3), (2, 3, 4)]


def test_hub_has_six_triangles(spark):
    rows = HUB + RIM + [(b, a) for a, b in RIM]
    assert len(tuples(patterns.triangles(edges(spark, rows)))) == 6


def test_square_plans_agree(spark):
    rows = sorted({(i * 7 % 13, i * 5 % 11) for i in range(60)})
    e = edges(spark, rows)
    want = patterns.squares_leftdeep(e).count()
    assert want == sum(1 for a, b in rows for b2, c in rows if b2 == b for c2, d in rows if c2 == c if (d, a) in set(rows))
    assert patterns.squares_bushy(e).count() == want
    for sizes in ([2, 2, 2, 2], [1, 2, 3, 1]):
        assert patterns.squares_hypercube(e, sizes).count() == want
        assert patterns.squares_hypercube(e, sizes, bushy=True).count() == want


def test_hypercube_slices():
    cube = hypercube.Hypercube([3, 3, 3])
    assert sorted(cube.slice([None, None, 1])) == [1, 4, 7, 10, 13, 16, 19, 22, 25]
    assert sorted(cube.slice([None, 1, None])) == [3, 4, 5, 12, 13, 14, 21, 22, 23]
    assert sorted(cube.slice([1, None, None])) == list(range(9, 18))
    for fixed in ([None, 1, None], [0, None, 2], [1, 1, 1]):
        inside = set(cube.slice(fixed))
        assert all(cube.contains(fixed, s) == (s in inside) for s in range(27))


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_int_root(k):
    assert all(hypercube.int_root(n, k) ** k <= n < (hypercube.int_root(n, k) + 1) ** k for n in range(3000))


def test_reducers_on_negatives_and_empty(spark):
    df = spark.createDataFrame([(-5,), (-3,), (-9,)], "v long")
    r = reduce.reduce_all(df, "v", reduce.REDUCERS).first()
    assert (r["r_max"], r["r_min"], r["r_add"], r["r_prod"], r["r_and"], r["r_xor"]) == (-3, -9, -17, -135.0, True, True)
    assert all(v is None for v in reduce.reduce_all(df.where("v > 0"), "v", ["add", "max", "min", "band"]).first())


def test_array_reduce_keeps_order(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([10, 20, 30],)], "a array<long>")
    assert reduce.reduce_arrays(df, "a").first()["a"] == [11, 22, 33]


def test_summary_of_one_row_has_no_deviation(spark):
    assert reduce.summary(spark.createDataFrame([("a", 2.0)], "k string, v double"), ["k"], "v").first()["stddev"] == 0.0


def test_argmax_ties_take_the_least_id(spark):
    df = spark.createDataFrame([(1, 7, 5.0), (1, 3, 5.0), (1, 9, -1.0), (1, 8, -1.0)], "k int, id int, v double")
    r = reduce.arg_best(df, ["k"], "id", "v").first()
    assert (r["argmax"], r["argmin"]) == (3, 8)


def test_cube_lattice_equals_cube(spark):
    df = spark.createDataFrame([(a, b, c, a * b + c) for a in range(3) for b in range(4) for c in range(2)] * 2, "a int, b int, c int, m long")
    dims = ["a", "b", "c"]
    assert sorted(map(repr, reduce.cube(df, dims, ["m"]).select(*dims, "view", "m").collect())) == sorted(
        map(repr, reduce.cube_lattice(df, dims, ["m"]).select(*dims, "view", "m").collect())
    )


@pytest.mark.parametrize("combine", [False, True])
def test_map_reduce_word_count(spark, combine):
    df = spark.range(1000).select(((F.col("id") * 541) % 33).alias("w"))
    add = lambda k, vs: [(k, sum(vs))]
    out = mapreduce.map_reduce(df, lambda r: [(r["w"], 1)], add, "w long, n long", "w long, n long", add if combine else None, buffer=7)
    rows = out.collect()
    assert len(rows) == 33 and sum(r["n"] for r in rows) == 1000


def test_prefix_sum_with_ties_and_empty(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, v long")
    got = {r["k"]: r["before"] for r in ordering.prefix_sum(df, "v", ["k"], parts=4).collect()}
    assert got == {i: sum(j % 3 for j in range(i)) for i in range(50)}
    assert ordering.prefix_sum(df.where("k < 0"), "v", ["k"]).count() == 0


def test_global_rank_and_sortedness(spark):
    keys = [5, 3, 5, 1, 9, 3, 3]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, key long")
    got = {r["i"]: r["rank"] for r in ordering.global_rank(df, "key").collect()}
    assert got == {i: sum(k2 < k for k2 in keys) for i, k in enumerate(keys)}
    bad = ordering.sortedness_violations(df, "i", "key", parts=3).collect()
    assert sorted(r["i"] for r in bad) == [i for i in range(1, len(keys)) if keys[i] < keys[i - 1]]


def test_containers(spark):
    v = spark.createDataFrame([(i, i * 10) for i in range(5)], "idx long, value long")
    popped, rest = containers.pop(v, 2)
    assert tuples(popped) == [(3, 30), (4, 40)] and tuples(containers.dequeue(rest, 1)[0]) == [(0, 0)]
    base = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long")
    changes = spark.createDataFrame([(2, 7, 1), (2, 8, 2), (3, 9, 1)], "k long, v long, at long")
    assert tuples(containers.upsert(base, changes, ["k"], "at")) == [(1, 5), (2, 8), (3, 9)]


CHAIN = [(i, i + 1) for i in range(20)]


@pytest.mark.parametrize("rows", [CHAIN, CHAIN + [(50, 51), (52, 51), (60, 60)], [], [(1, 2), (2, 1), (1, 2)], [(9, 1), (9, 2), (9, 3), (3, 4)]])
def test_components(spark, rows):
    parent = {x: x for e in rows for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in parent)
    for one_task in (0, cc.ONE_TASK):
        assert tuples(cc.components(edges(spark, rows), one_task=one_task)) == want
    assert tuples(graph.min_label(edges(spark, rows)).select("id", "component")) == want


@pytest.mark.parametrize("mode", ["push", "pull", "hybrid"])
def test_bfs(spark, mode):
    rows = SMALL + [(10, 11)]
    u = graph.symmetrize(edges(spark, rows))
    tree = graph.bfs(u, spark.range(5, 6), mode)
    assert {r["id"]: r["level"] for r in tree.collect()} == {5: 0, 1: 1, 4: 1, 2: 2, 3: 2}
    assert graph.bfs_violations(u, tree, 5).count() == 0
    broken = tree.withColumn("level", F.when(F.col("id") == 3, 9).otherwise(F.col("level")))
    assert graph.bfs_violations(u, broken, 5).count() > 0


def test_sssp(spark):
    e = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 1.0), (5, 6, 1.0)], "src long, dst long, weight double")
    tree = graph.sssp(e, 0)
    assert tuples(tree) == [(0, 0.0, 0), (1, 3.0, 2), (2, 1.0, 0), (3, 4.0, 1)]
    assert graph.sssp_violations(e, tree, 0).count() == 0
    assert graph.sssp_violations(e, tree.withColumn("dist", F.col("dist") + (F.col("id") == 3).cast("int")), 0).count() > 0


def test_colored_paths_are_simple(spark):
    e = edges(spark, [(0, 1), (1, 0), (1, 2), (2, 1)])
    colors = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "id long, color int")
    assert graph.colored_paths(e, colors, [0, 1, 0]).first()["paths"] == 2


@pytest.mark.parametrize("n, solutions", [(1, 1), (4, 2), (6, 4)])
def test_n_queens(spark, n, solutions):
    assert graph.n_queens(spark, n).first()["solutions"] == solutions


def test_kmeans_exact_means(spark):
    p = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (10.0, 10.0), (10.0, 11.0), (9.0, 10.0)], "a double, b double")
    means = graph.kmeans(p, ["a", "b"], [[0.0, 0.0], [10.0, 10.0]], 5, tolerance=0.0)
    assert means[0] == [0.0, 0.5] and means[1] == pytest.approx([29 / 3, 31 / 3])


def test_grown_pieces_keep_every_row(spark):
    g = graph.Grown(spark.range(0, 1))
    for k in range(1, 20):
        g.add(spark.range(k, k + 1))
    assert sorted(r["id"] for r in g.rows().collect()) == list(range(20))
    assert sum(map(len, g.tiers)) < 2 * graph.FAN


def test_search_and_distances_over_more_rounds_than_pieces(spark):
    """A path with a longer way round: distances fall in later rounds, and pieces are merged on the way."""
    path = [(i, i + 1, 1.0) for i in range(20)] + [(0, 20, 50.0)]
    e = spark.createDataFrame(path, "src long, dst long, weight double")
    assert sorted(map(tuple, graph.sssp(e, 0).collect())) == [(i, float(i), max(0, i - 1)) for i in range(21)]
    chain = e.where("dst <> 20").select("src", "dst")
    for mode in ("push", "pull", "hybrid"):
        assert sorted(map(tuple, graph.bfs(chain, spark.range(1), mode).collect())) == [(i, i, max(0, i - 1)) for i in range(20)]
    alone = graph.bfs(chain, spark.range(99, 100)).collect()
    assert [tuple(r) for r in alone] == [(99, 0, 99)]


def test_many_means_agree_with_literals(spark, monkeypatch):
    p = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(40)], "a double, b double")
    start = [[float(i), float(i % 3)] for i in range(6)]
    want = graph.kmeans(p, ["a", "b"], start, 4)
    monkeypatch.setattr(graph, "LITERAL_MEANS", 2)
    assert graph.kmeans(p, ["a", "b"], start, 4) == want
    assert len(graph.kmeans(p, ["a", "b"], start, 2, fraction=0.5)) == 6


def test_normalised_points(spark):
    p = spark.createDataFrame([(1.0, 0.0), (3.0, 0.0)], "a double, b double")
    assert sorted(map(tuple, graph.normalised(p, ["a", "b"]).collect())) == [(0.25, 0.0), (0.75, 0.0)]


@pytest.mark.parametrize("values", [[], [None], [5.0], [1.0, 2.0, 2.0, 10.0, None], [float(x * x % 17) for x in range(50)]])
def test_quartiles_by_rank(spark, values):
    import numpy as np

    row = reduce.quartiles(spark.createDataFrame([(v,) for v in values], "v double"), "v").select("q1", "median", "q3").first()
    held = [v for v in values if v is not None]
    want = np.percentile(held, [25, 50, 75]).tolist() if held else [None] * 3
    assert list(row) == (pytest.approx(want) if held else want)


def test_reducer_streams_values_and_may_stop_early(spark):
    df = spark.range(25_000).selectExpr("id", "id % 2 as k")
    first = lambda k, vs: [(k, next(iter(vs)) % 2)]
    out = mapreduce.map_reduce(df, lambda r: [(r["k"], r["id"])], first, "k long, v long", "k long, parity long")
    assert sorted(map(tuple, out.collect())) == [(0, 0), (1, 1)]


def test_metrics_of_parts_are_those_of_the_whole(spark):
    asked = []
    m = metrics.Metrics({"host": "a"}, {"calls": lambda: asked.append(1) or len(asked)})
    kinds = {"s": (metrics.total, "v"), "top": (metrics.most, "v"), "all": (metrics.summary, "v"), "h": (metrics.histogram([2, 5]), "v")}
    values = [1.0, 2.0, 4.0, 5.0, 9.0, None]
    for part in (values[:2], values[2:], []):
        m.watch(spark.createDataFrame([(v,) for v in part], "v double"), **kinds).collect()
    got = m.read()
    held = values[:5]
    mean = sum(held) / 5
    assert (got["s"], got["top"], got["host"], got["calls"]) == (21.0, 9.0, "a", 1)
    assert got["h"] == {"bin0": 1, "bin1": 2, "bin2": 2}
    assert got["all"] == pytest.approx({"count": 5, "mean": mean, "stddev": (sum((v - mean) ** 2 for v in held) / 4) ** 0.5, "min": 1.0, "max": 9.0})
    assert '"top": 9.0' in m.to_json()
    m.reset()
    assert set(m.read()) == {"host", "calls"}


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_every_delta_sent_gives_the_ranks_of_as_many_rounds(spark, rounds):
    e = edges(spark, [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (5, 1), (6, 5), (7, 7)])
    delta, plain = (dict(tuples(r)) for r in (graph.pagerank_delta(e, 0.0, most=rounds), graph.pagerank(e, rounds)))
    assert set(delta) == set(plain) == set(range(1, 8))
    assert all(abs(delta[i] - plain[i]) < 1e-12 for i in plain)


@pytest.mark.parametrize("rows", [[], [(1, 2)], [(1, 2), (2, 1)], [(3, 3)]])
def test_delta_ranks_of_graphs_without_still_or_moving_vertices(spark, rows):
    e = edges(spark, rows)
    delta, plain = (dict(tuples(r)) for r in (graph.pagerank_delta(e, 0.0, most=3), graph.pagerank(e, 3)))
    assert set(delta) == set(plain) and all(abs(delta[i] - plain[i]) < 1e-12 for i in plain)


def test_delta_ranks_keep_their_sum_when_single_changes_are_small(spark):
    """A ring that many vertices point at: each change of the ring is below a thousandth long before their sum is."""
    n = 3000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    r = graph.pagerank_delta(ring.union(spark.range(n, 2 * n).select(F.col("id").alias("src"), (F.col("id") - n).alias("dst"))), 0.0, most=40)
    inner = outer = 1.0
    for _ in range(40):
        inner, outer = 0.15 + 0.85 * (inner + outer), 0.15
    assert r.count() == 2 * n
    assert abs(r.agg(F.sum("rank")).first()[0] - n * (inner + outer)) < 1e-6


def reference_common(rows):
    found = {}
    for a, x in set(rows):
        for b, y in set(rows):
            if x == y and a < b:
                found.setdefault((a, b), []).append(x)
    return sorted((a, b, len(v), min(v)) for (a, b), v in found.items())


#: Seven sources and neighbours that share most of one another, one list longer than the rest, and ids of all 64 bits.
DENSE = [(s, d) for s in range(7) for d in range(9) if (s * 5 + d * 3) % 7 < 4] + [(s, 100) for s in range(60)]
WIDE = [(-(2**63), 1), (2**63 - 1, 1), (0, 1), (2**62, -5), (0, -5), (-(2**63), -5)]


@pytest.mark.parametrize("rows", [SMALL, HUB, [], [(1, 1)], DENSE + DENSE[:20], WIDE], ids=["small", "hub", "empty", "loop", "dense", "wide"])
@pytest.mark.parametrize("pairs", [1, 64, 1 << 20])
def test_common_neighbours(spark, rows, pairs, monkeypatch):
    monkeypatch.setattr(intersect, "PAIRS", pairs)
    assert tuples(intersect.common_neighbours(edges(spark, rows))) == reference_common(rows)


@pytest.mark.parametrize("limit", [1, 5, 1 << 18])
def test_lists_cut_and_pairs_folded_at_any_size(limit, monkeypatch):
    """The two steps outside Spark, with so little held at once that lists span batches and pairs are folded often."""
    monkeypatch.setattr(intersect, "EDGES", limit)
    monkeypatch.setattr(intersect, "HELD", limit)
    monkeypatch.setattr(intersect, "ROWS", 3)
    for rows in (DENSE + DENSE[:20], WIDE):
        dst, src = zip(*sorted((d, s) for s, d in rows))
        batches = [pa.RecordBatch.from_pydict({"src": src[k:k + 4], "dst": dst[k:k + 4]}) for k in range(0, len(src), 4)]
        pieces = [piece for b in intersect.cut_lists(iter(batches), 3) for piece in b.to_pylist()]
        found = [b for k in range(3) for b in intersect.shared((p for p in pieces if p["block"] == k), k, 3)]
        assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == reference_common(rows)


@pytest.mark.parametrize("ids", [[0], [5, 5, 5], [-(2**63), 2**63 - 1, 0, -1], list(range(0, 10**6, 997))])
def test_packed_ids_come_back(ids):
    assert intersect.unpack(intersect.pack(np.array(ids, np.int64))).tolist() == ids


def test_pairs_of_sources_are_never_shuffled(spark, sf_dir):
    """The query joins nothing, and what it sends of lists is a few bytes for each pair, where a row takes 24 at least."""
    plan = registry.queries()["set_intersect_choose"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    rng = np.random.default_rng(7)
    src = np.concatenate([np.sort(rng.choice(150_000, 30, replace=False)) for _ in range(4000)])
    edges = pa.RecordBatch.from_pydict({"src": src, "dst": np.repeat(np.arange(4000), 30)})
    sent = sum(b.nbytes for b in intersect.cut_lists(iter([edges]), 16))
    assert sent < 3 * 4000 * 30 * 29 / 2
