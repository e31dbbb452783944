"""Aggregations: user folds, reducers, statistics, cubes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reduction operators by name. Logical ones take non-zero as true; logical xor is the parity of the true values.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "add": F.sum,
    "max": F.max,
    "min": F.min,
    "prod": F.product,
    "or": lambda c: F.bool_or(c != 0),
    "and": lambda c: F.bool_and(c != 0),
    "bor": F.bit_or,
    "band": F.bit_and,
    "bxor": F.bit_xor,
    "xor": lambda c: (F.sum((c != 0).cast("long")) % 2) == 1,
}


def reduce_all(df: DataFrame, column: str, ops: Iterable[str]) -> DataFrame:
    """One row with the reduction of a column by each operator; null for an empty input."""
    return df.agg(*[REDUCERS[o](F.col(column)).alias(f"r_{o}") for o in ops])


def all_reduce(df: DataFrame, column: str, op: str, name: str) -> DataFrame:
    """df with the reduction on every row. The reduced side is one row, so broadcasting it is safe."""
    return df.crossJoin(F.broadcast(df.agg(REDUCERS[op](F.col(column)).alias(name))))


def reduce_arrays(df: DataFrame, column: str, op: str = "add") -> DataFrame:
    """Element-wise reduction of an array column to one array, in order. Partial sums are made before the shuffle."""
    parts = df.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(REDUCERS[op](F.col("v")).alias("v"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(column))


def fold(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], init: Column, step) -> DataFrame:
    """User aggregate state' = step(state, value), over the values of a group in a stated order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*keys).agg(F.aggregate(ordered, init, lambda s, x: step(s, x["__v"])).alias("state"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by a stated order, as one aggregation: no window, so a hot key is combined early."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in (*order, *rest)])


def arg_best(df: DataFrame, keys: Sequence[str], id_col: str, value: str) -> DataFrame:
    """Largest and smallest value with the least id that has it."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(id_col), F.struct(F.col(value), -F.col(id_col)))[id_col].alias("argmax"),
        F.max(value).alias("max_value"),
        F.min(F.struct(F.col(value), F.col(id_col)))[id_col].alias("argmin"),
        F.min(value).alias("min_value"),
    )


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, sample deviation (0 for a single row), least and largest."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"),
        F.min(value).alias("least"), F.max(value).alias("largest"),
    )


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """Exact quartiles (interpolated between the two ranks beside them) with mean, deviation, harmonic mean and its
    deviation (of positive values). Nulls take no part; an empty input gives nulls.

    Ranks come from counts of distinct values and a prefix sum over their ranges, so no buffer holds all values."""
    from burrstone.operators.ordering import prefix_sum

    x = df.select(F.col(value).alias("x")).where(F.col("x").isNotNull())
    ranked = prefix_sum(x.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "n", ["x"])
    n = ranked.agg(F.sum("n")).first()[0] or 0

    def at(rank: int) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (F.col("before") + F.col("n") > rank), F.col("x").cast("double")))

    def quantile(share: float) -> Column:
        place = share * max(0, n - 1)
        low, part = int(place), place - int(place)
        return at(low) * (1 - part) + at(low + 1) * part if part else at(low)

    cuts = ranked.agg(quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"))
    inverse = 1 / F.col("x")
    rest = x.agg(
        F.min("x").alias("least"), F.max("x").alias("largest"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("stddev"), (F.count("x") / F.sum(inverse)).alias("harmonic_mean"),
        (F.stddev_samp(inverse) / F.sqrt(F.count("x") - 1) * F.pow(F.count("x") / F.sum(inverse), F.lit(2))).alias("harmonic_stddev"),
    )
    names = ["least", "q1", "median", "q3", "largest", "mean", "stddev", "harmonic_mean", "harmonic_stddev"]
    return rest.crossJoin(F.broadcast(cuts)).select(*names)  # one row each


def views(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets of the dimensions."""
    return [v for k in range(1, len(dims) + 1) for v in combinations(dims, k)]


def cube(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums for every non-empty subset of the dimensions; view tells absent dimensions (1 bits, first highest)."""
    out = df.cube(*dims).agg(F.grouping_id().alias("view"), *[F.sum(m).alias(m) for m in measures])
    return out.where(F.col("view") != (1 << len(dims)) - 1)


def cube_lattice(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The same from the finest view down the lattice: each view sums the view with one more dimension.

    Catalyst's CUBE copies every input row 2**n times before it sums; here the input is read and summed once, and each
    coarser view reads the smallest of the views with one more dimension, which is why this form is for many dimensions.
    Sizes of all views are estimated in one pass over the finest; an estimate only chooses among parents that give the
    same sums.
    """
    from burrstone.session import cut

    finest = cut(df.groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures]))
    lattice = sorted(views(dims), key=len, reverse=True)
    # Nulls are values of a dimension too, so views are hashed and not counted as they are.
    sizes = dict(zip(lattice, finest.agg(*[F.approx_count_distinct(F.xxhash64(*v)).alias(f"s{i}") for i, v in enumerate(lattice)]).first(), strict=True))
    done = {tuple(dims): finest}
    for v in lattice[1:]:
        parent = min((tuple(d for d in dims if d in v or d == extra) for extra in dims if extra not in v), key=sizes.get)
        done[v] = done[parent].groupBy(*v).agg(*[F.sum(m).alias(m) for m in measures])
    types = dict(df.dtypes)
    out = None
    for v, rows in done.items():
        mask = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in v)
        part = rows.select(*[F.col(d) if d in v else F.lit(None).cast(types[d]).alias(d) for d in dims], F.lit(mask).cast("long").alias("view"), *measures)
        out = part if out is None else out.unionByName(part)
    return out


def vector_mean(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each component; sums and counts travel, never means of means."""
    parts = df.select(*keys, F.posexplode(column).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(column))
