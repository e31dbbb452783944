"""All queries of the package, with the SQL that each is checked against."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from burrstone.operators.metrics import Metrics
from burrstone.session import cut

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return put


def _load() -> None:
    from burrstone import plans  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


@dataclass
class Run:
    """A query that ran: its written result, the counters that it watched, and the seconds of its two steps."""

    result: DataFrame
    counters: dict
    preprocessing: float
    execution: float


def run_query(preprocessing: Callable[[], DataFrame], execute: Callable[[DataFrame, Metrics], DataFrame]) -> Run:
    """Run a query in two timed steps: preprocessing gives its input, which is written, and execute gives the result of
    the input and watches the sizes of what it makes on the way."""
    began = time.perf_counter()
    ready = cut(preprocessing())
    middle = time.perf_counter()
    counters = Metrics()
    result = cut(execute(ready, counters))
    return Run(result, counters.read(), middle - began, time.perf_counter() - middle)
