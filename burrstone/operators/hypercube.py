"""One-round multiway joins over a hypercube of cells.

Each join variable is an axis with a share; a tuple is copied to every cell that agrees with it on the axes it has.
The cell of a result is fixed by its variables, so every result has exactly one home cell and none is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int_root(n: int, k: int) -> int:
    """floor(n ** (1 / k)) in integers."""
    if n < 0 or k < 1:
        raise ValueError("int_root needs n >= 0 and k >= 1")
    r = round(n ** (1.0 / k))
    while r**k > n:
        r -= 1
    while (r + 1) ** k <= n:
        r += 1
    return r


def shares(cells: int, axes: int) -> list[int]:
    """Equal shares whose product is at most the number of cells."""
    return [max(1, int_root(cells, axes))] * axes


class Hypercube:
    """Serial numbers and slices of a grid; the first axis varies fastest in neither: serial = sum of pos * stride."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)
        self.strides = [1] * len(sizes)
        for i in range(len(sizes) - 2, -1, -1):
            self.strides[i] = self.strides[i + 1] * self.sizes[i + 1]

    def serial(self, position: Sequence[int]) -> int:
        return sum(p * s for p, s in zip(position, self.strides, strict=True))

    def slice(self, fixed: Sequence[int | None]) -> Iterator[int]:
        """Serials of the cells that agree with the fixed positions; None is a wildcard."""
        for p in product(*[range(n) if f is None else [f] for f, n in zip(fixed, self.sizes, strict=True)]):
            yield self.serial(p)

    def contains(self, fixed: Sequence[int | None], serial: int) -> bool:
        return all(f is None or serial // s % n == f for f, s, n in zip(fixed, self.strides, self.sizes, strict=True))


def axis_hash(value: Column, share: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(share)).cast("int")


def replicate(df: DataFrame, variables: Sequence[str | None], cube: Hypercube) -> DataFrame:
    """df with a column cell, one row for each cell of its slice; variables[i] is the column on axis i, None a wildcard."""
    cell: Column = F.lit(0)
    out = df
    for i, v in enumerate(variables):
        if v is None:
            out = out.withColumn(f"__a{i}", F.explode(F.sequence(F.lit(0), F.lit(cube.sizes[i] - 1))))
            cell = cell + F.col(f"__a{i}") * cube.strides[i]
        else:
            cell = cell + axis_hash(F.col(v), cube.sizes[i]) * cube.strides[i]
    return out.withColumn("cell", cell.cast("int")).drop(*[f"__a{i}" for i, v in enumerate(variables) if v is None])


def cell_join(parts: Sequence[tuple[DataFrame, Sequence[str | None]]], sizes: Sequence[int], plan=None) -> DataFrame:
    """Join replicated relations inside cells. plan folds the list of replicated relations; by default left to right on
    all columns they share (cell among them). All relations are shuffled once, on the cell; later joins keep it."""
    cube = Hypercube(sizes)
    n = 1
    for s in sizes:
        n *= s
    held = [replicate(df, vs, cube).repartition(n, "cell") for df, vs in parts]
    if plan is not None:
        return plan(held)
    out = held[0]
    for df in held[1:]:
        out = out.join(df, [c for c in out.columns if c in df.columns])
    return out
