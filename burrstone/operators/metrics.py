"""Metrics of running queries: values that are gathered while a query runs, not by another pass over its rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def total(c: Column) -> dict[str, Column]:
    return {"sum": F.sum(c)}


def most(c: Column) -> dict[str, Column]:
    return {"max": F.max(c)}


def summary(c: Column) -> dict[str, Column]:
    """count, mean, sample deviation, least and largest."""
    return {"count": F.count(c), "mean": F.avg(c), "stddev": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}


def histogram(bounds: Sequence[float]) -> Callable[[Column], dict[str, Column]]:
    """Counts of values below the first bound, between bounds (lower one included), and from the last one on."""
    edges = [None, *bounds, None]

    def made(c: Column) -> dict[str, Column]:
        out = {}
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            inside = F.lit(True) if low is None else c >= low
            out[f"bin{i}"] = F.count_if(c.isNotNull() & inside & (F.lit(True) if high is None else c < high))
        return out

    return made


class Metrics:
    """Metrics by name: kinds of a column (total, most, summary, histogram), texts, and callbacks that are asked when
    the metrics are read. Each watched DataFrame has its values once an action on it has run; watching the same name
    again, for another part of a job, merges sums, counts and extremes. Means and deviations are merged by counts."""

    def __init__(self, texts: Mapping[str, str] | None = None, callbacks: Mapping[str, Callable[[], object]] | None = None):
        self.texts, self.callbacks = dict(texts or {}), dict(callbacks or {})
        self.reset()

    def reset(self) -> None:
        self._watched: list[tuple[Observation, list[tuple[str, str]]]] = []

    def watch(self, df: DataFrame, **kinds: tuple[Callable[[Column], dict[str, Column]], Column | str]) -> DataFrame:
        """df, which gathers name=(kind, column) on its way."""
        seen, parts, columns = Observation(), [], []
        for name, (kind, c) in kinds.items():
            for part, value in kind(F.col(c) if isinstance(c, str) else c).items():
                columns.append(value.alias(f"m{len(parts)}"))
                parts.append((name, part))
        self._watched.append((seen, parts))
        return df.observe(seen, *columns)

    def read(self) -> dict[str, object]:
        """All values; waits for the actions on the watched DataFrames. A metric with one part is that value."""
        out: dict[str, dict] = {}
        for seen, parts in self._watched:
            values = seen.get
            one: dict[str, dict] = {}
            for i, (name, part) in enumerate(parts):
                one.setdefault(name, {})[part] = values[f"m{i}"]
            for name, new in one.items():
                out[name] = _merged(out[name], new) if name in out else new
        flat = {k: v["sum"] if set(v) == {"sum"} else v["max"] if set(v) == {"max"} else v for k, v in out.items()}
        return {**flat, **self.texts, **{k: f() for k, f in self.callbacks.items()}}

    def to_json(self) -> str:
        return json.dumps(self.read(), sort_keys=True, default=str)


def _merged(a: dict, b: dict) -> dict:
    def both(f, part):
        held = [x[part] for x in (a, b) if x[part] is not None]
        return f(held) if held else None

    out = {p: both({"max": max, "min": min}.get(p, sum), p) for p in a if p not in ("mean", "stddev")}
    if "mean" in a:
        n = out["count"]
        out["mean"] = sum(x["mean"] * x["count"] for x in (a, b) if x["count"]) / n if n else None
        squares = sum((x["stddev"] or 0.0) ** 2 * (x["count"] - 1) + x["count"] * (x["mean"] - out["mean"]) ** 2 for x in (a, b) if x["count"])
        out["stddev"] = (squares / (n - 1)) ** 0.5 if n > 1 else None
    return out
