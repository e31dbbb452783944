"""Map, combine and reduce with user functions, where expressions can't say it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame


def map_reduce(
    df: DataFrame,
    mapper: Callable[[dict], Iterable[tuple]],
    reducer: Callable[[object, Iterable], Iterable[tuple]],
    pairs: str,
    out: str,
    combiner: Callable[[object, list], Iterable[tuple]] | None = None,
    buffer: int = 100_000,
) -> DataFrame:
    """mapper(row) gives (key, value) pairs, reducer(key, values) gives rows of schema out.

    pairs is "key type, value type". A combiner runs on what a task has gathered before the shuffle, at most buffer keys
    at a time, and must give pairs again. Values of one key meet in one reducer call, which gets them as an iterator over
    Arrow batches and can read them once, so a hot key takes time but no memory; a combiner saves the time as well.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    emitted, given = _parse_datatype_string(pairs), _parse_datatype_string(out)
    arrow, key = to_arrow_schema(emitted), emitted.fieldNames()[0]
    result, value = to_arrow_schema(given), emitted.fieldNames()[1]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (kv for b in batches for row in b.to_pylist() for kv in mapper(row))
        if combiner is None:
            while rows := list(islice(stream, 10_000)):
                yield table(rows)
            return
        held: dict = {}
        for k, v in stream:
            held.setdefault(k, []).append(v)
            if len(held) >= buffer:
                yield table([kv for k2, vs in held.items() for kv in combiner(k2, vs)])
                held.clear()
            elif len(held[k]) >= 1024:
                held[k] = [v2 for _, v2 in combiner(k, held[k])]
        if held:
            yield table([kv for k, vs in held.items() for kv in combiner(k, vs)])

    def reduced(keys, batches):
        values = (v for b in batches for v in b.column(value).to_pylist())
        rows = iter(reducer(keys[0].as_py(), values))
        while some := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], type=f.type) for i, f in enumerate(result)], schema=result)
        for _ in values:  # what the reducer left unread
            pass

    # Spark tells the form that reads batches by its annotations.
    reduced.__annotations__ = {"keys": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return df.mapInArrow(mapped, pairs).groupBy(key).applyInArrow(reduced, out)
