"""Scalar helpers as Column functions."""

from __future__ import annotations

from itertools import combinations
from math import comb, lcm

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_keep(s: Column, delimiter: str) -> Column:
    """Pieces between delimiters; empty ones inside are kept, a trailing empty one is not."""
    import re

    parts = F.split(s, re.escape(delimiter))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(s: Column, separators: str) -> Column:
    """Pieces between any of a set of separator characters, empty ones dropped."""
    import re

    return F.filter(F.split(s, f"[{re.escape(separators)}]+"), lambda x: x != "")


def parse_int(s: Column) -> Column:
    """A whole number of up to 64 bits; null if the text is none."""
    return s.try_cast("long")


def parse_double(s: Column) -> Column:
    return s.try_cast("double")


def int_root(n: Column, k: int) -> Column:
    """floor(n ** (1 / k)) with an integer correction of the floating guess."""
    guess = F.floor(F.pow(n.cast("double"), F.lit(1.0 / k)) + 1e-9).cast("long")

    def power(x: Column) -> Column:
        out = x
        for _ in range(k - 1):
            out = out * x
        return out

    return F.when(power(guess) > n, guess - 1).when(power(guess + 1) <= n, guess + 1).otherwise(guess)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x))


def pair_hash(a: Column, b: Column, modulus: int) -> Column:
    return F.pmod(a * 31 + b, F.lit(modulus))


def pair_concat(a: Column, b: Column) -> Column:
    """The low 32 bits of both in one 64-bit key."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(low(a), 32).bitwiseOR(low(b))


def elementwise(f, kind: str = "long"):
    """Any function of whole columns (pandas Series in, Series out) as a Column function, run on Arrow batches."""
    return F.pandas_udf(f, kind)


def choose(n: int, k: int) -> int:
    return comb(n, k)


def mask_to_dims(mask: int, n: int) -> list[int]:
    return [i for i in range(n) if mask >> i & 1]


def dims_to_mask(dims: list[int]) -> int:
    return sum(1 << d for d in dims)


def expected_view_size(periods: list[int]) -> int:
    """Distinct tuples of residue walks with these periods."""
    return lcm(*periods) if periods else 0


def subsets(n: int) -> list[int]:
    """Masks of all non-empty subsets, fewest dimensions first."""
    return [dims_to_mask(list(c)) for k in range(1, n + 1) for c in combinations(range(n), k)]
