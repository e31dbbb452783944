"""Deterministic generators of edges, trees, keys, points and cube tuples."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of its parts: the same for the same parts, wherever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def scramble(vertex: Column, scale: int, seed: int) -> Column:
    """A permutation of [0, 2**scale): an odd multiplier, a shift of high bits onto low ones, and another round."""
    mask = (1 << scale) - 1
    odd = [((seed * 2 + 1) * 40503) & mask | 1, ((seed + 7) * 30103) & mask | 1]
    # Products stay below 2**62 for scales up to 31, the largest this is for.
    x = vertex
    for m in odd:
        x = (x * F.lit(m).cast("long")).bitwiseAND(F.lit(mask).cast("long"))
        x = x.bitwiseXOR(F.shiftright(x, max(1, scale // 2)))
    return x


def kronecker(spark: SparkSession, scale: int, n_edges: int, seed: int = 11111, noise: float = 0.0) -> DataFrame:
    """Power-law edges: each bit of both ends falls into a quadrant with probabilities .57, .19, .19 and .05.

    noise shifts the first probability by bit and edge, as the recursive-matrix form does. Ids are permuted.
    """
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        u = unit(F.col("id"), F.lit(bit), F.lit(seed))
        a = F.lit(0.57) + (F.lit(noise) * (unit(F.col("id"), F.lit(bit), F.lit(seed + 1)) - 0.5) if noise else F.lit(0.0))
        src = src + F.when(u >= a + 0.19, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        dst = dst + F.when(((u >= a) & (u < a + 0.19)) | (u >= a + 0.38), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    return spark.range(n_edges).select(scramble(src, scale, seed).alias("src"), scramble(dst, scale, seed).alias("dst"))


def mesh(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Edges of a grid to the right and down."""
    v = spark.range(rows * columns)
    right = v.where(F.col("id") % columns < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = v.where(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return right.union(down)


def balanced_tree(spark: SparkSession, n: int, arity: int) -> DataFrame:
    """Edges from parent to child of the complete tree of n vertices."""
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / arity).alias("src"), F.col("id").alias("dst"))


def complete(spark: SparkSession, n: int) -> DataFrame:
    """All ordered pairs of different vertices, one task-sized row range at a time."""
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where("src <> dst")


def tuples(spark: SparkSession, n: int, fields: int, below: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select(*[F.floor(unit(F.col("id"), F.lit(k), F.lit(seed)) * below).cast("long").alias(f"c{k}") for k in range(fields)])


def near_gaussian_keys(spark: SparkSession, n: int, below: int, seed: int = 1) -> DataFrame:
    """Keys that are means of four uniform numbers."""
    mean = sum((unit(F.col("id"), F.lit(k), F.lit(seed)) for k in range(1, 4)), unit(F.col("id"), F.lit(0), F.lit(seed))) / 4
    return spark.range(n).select(F.col("id"), F.floor(mean * below).cast("long").alias("key"))


def points(spark: SparkSession, n: int, dims: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.array(*[unit(F.col("id"), F.lit(k), F.lit(seed)) for k in range(dims)]).alias("point"))


def cube_tuples(spark: SparkSession, n: int, attributes: Sequence[tuple[int, int, int]], measures: int) -> DataFrame:
    """Residue walks: attribute i of tuple t is start * generator**t modulo prime; measure m is a function of the first.

    attributes holds (start, generator, prime). The power is taken by squaring, one factor for each bit of t.
    """

    def power(t: Column, g: int, p: int, bits: int) -> Column:
        out, square = F.lit(1).cast("long"), g % p
        for b in range(bits):
            factor = F.when(F.shiftright(t, b).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(square)).otherwise(F.lit(1))
            out = (out * factor) % p
            square = square * square % p
        return out

    bits = max(1, n.bit_length())
    walk = [((power(F.col("id"), g, p, bits) * s) % p).alias(f"a{i}") for i, (s, g, p) in enumerate(attributes)]
    out = spark.range(n).select("id", *walk)
    return out.select(*[f"a{i}" for i in range(len(attributes))], *[((F.col("a0") + 1) * (m + 1) * F.col("id") % 31415).alias(f"m{m}") for m in range(measures)])


#: Shapes of geometric trees.
LINEAR, EXPONENTIAL, CYCLIC, FIXED = range(4)


class TreeRandom:
    """A splittable generator: the state of a child is the SHA-1 of its parent's state and its number."""

    @staticmethod
    def root(seed: int) -> bytes:
        return hashlib.sha1(bytes(16) + seed.to_bytes(4, "big")).digest()

    @staticmethod
    def child(state: bytes, number: int) -> bytes:
        return hashlib.sha1(state + number.to_bytes(4, "big")).digest()

    @staticmethod
    def uniform(state: bytes) -> float:
        return (int.from_bytes(state[16:], "big") & 0x7FFFFFFF) / 2147483648.0


def n_children(state: bytes, depth: int, kind: str, b0: float, most_depth: int, shape: int, q: float, m: int) -> int:
    """Children of a node of a binomial, geometric or balanced tree."""
    if kind == "balanced":
        return int(b0) if depth < most_depth else 0
    if kind == "binomial":
        if depth == 0:
            return int(math.floor(b0))
        return m if TreeRandom.uniform(state) < q else 0
    b = b0
    if depth > 0:
        if shape == EXPONENTIAL:
            b = b0 * depth ** (-math.log(b0) / math.log(most_depth))
        elif shape == CYCLIC:
            b = 0.0 if depth > 5 * most_depth else b0 ** math.sin(2.0 * math.pi * depth / most_depth)
        elif shape == FIXED:
            b = b0 if depth < most_depth else 0.0
        else:
            b = b0 * (1.0 - depth / most_depth)
    if b <= 0:
        return 0
    return min(100, math.floor(math.log(1 - TreeRandom.uniform(state)) / math.log(1 - 1 / (1 + b))))


def unbalanced_tree(
    spark: SparkSession, seed: int, kind: str = "geometric", b0: float = 4.0, most_depth: int = 6,
    shape: int = FIXED, q: float = 0.2, m: int = 4, hybrid_shift: float = 0.5, partitions: int = 8,
):
    """Rows (depth, nodes, leaves) of the tree, level by level; a level's states are spread over all tasks.

    A hybrid tree is geometric down to hybrid_shift of its depth and binomial below.
    """
    from burrstone.session import cut

    def of(depth: int) -> str:
        if kind != "hybrid":
            return kind
        return "geometric" if depth < hybrid_shift * most_depth else "binomial"

    level = spark.createDataFrame([(bytearray(TreeRandom.root(seed)),)], "state binary")
    rows, depth = [], 0
    while True:
        branch = of(depth)

        def grow(batches, depth=depth, branch=branch):
            import pyarrow as pa

            for b in batches:
                states, numbers = b.column(0).to_pylist(), []
                numbers = [n_children(s, depth, branch, b0, most_depth, shape, q, m) for s in states]
                kids = [[TreeRandom.child(s, i) for i in range(n)] for s, n in zip(states, numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(kids, pa.list_(pa.binary()))], names=["kids"])

        grown = cut(level.mapInArrow(grow, "kids array<binary>"))
        s = grown.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("kids") == 0).alias("leaves"), F.sum(F.size("kids")).alias("kids")).first()
        rows.append((depth, s["n"], s["leaves"]))
        if not s["kids"]:
            return spark.createDataFrame(rows, "depth int, nodes long, leaves long")
        level = grown.select(F.explode("kids").alias("state")).repartition(partitions)
        depth += 1
