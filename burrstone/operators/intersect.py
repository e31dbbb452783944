"""Intersections of the neighbour sets of all pairs of vertices, without a shuffle of the pairs."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a block has on average; edges that a task cuts into pieces at once; ids or pairs laid out at once.
PAIRS = 1 << 20
EDGES = 1 << 18
HELD = 1 << 22
#: Rows of a batch of results.
ROWS = 1 << 16

_PIECE = pa.schema([("block", pa.int64()), ("neighbours", pa.binary()), ("sizes", pa.binary()), ("members", pa.binary())])
_RESULT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32()), ("chosen", pa.int64())])


def pack(x: np.ndarray) -> bytes:
    """64-bit integers, one at least, as compressed bytes of their differences: sorted ids take two or three bytes each."""
    d = np.diff(x, prepend=np.int64(0))
    u = ((d << 1) ^ (d >> 63)).astype("<i8").view("<u8")
    width = max(1, (int(u.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(u.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(x), width) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", packed)
    planes = np.frombuffer(pa.decompress(packed[9:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    u = np.zeros((n, 8), np.uint8)
    u[:, :width] = planes.T
    u = u.view("<u8").ravel()
    return np.cumsum((u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64))


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(blocks)).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before; the first does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first, so many of them, one range after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _pieces(src: np.ndarray, dst: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """For whole lists in order of (dst, src): what each block needs of them, from its first member of a list to the
    list's end."""
    kept = _starts(dst, src)
    src, dst = src[kept], dst[kept]
    heads = _starts(dst)
    sizes = np.diff(np.append(heads, len(dst)))
    block = block_of(src, blocks)
    _, first = np.unique(np.repeat(np.arange(len(heads)), sizes) * blocks + block, return_index=True)
    size = np.repeat(heads + sizes, sizes)[first] - first
    first, size = first[size > 1], size[size > 1]
    order = np.argsort(block[first], kind="stable")
    first, size = first[order], size[order]
    owner = block[first]
    if not len(first):
        return
    cuts = np.append(_starts(owner), len(first))
    ids = np.append(0, np.cumsum(size))
    k = 0
    while k + 1 < len(cuts):  # as many blocks as fit, one at least
        end = max(k + 1, int(np.searchsorted(ids[cuts], ids[cuts[k]] + HELD, "right")) - 1)
        members = src[_ranges(first[cuts[k]:cuts[end]], size[cuts[k]:cuts[end]])]
        rows = []
        for lo, hi in zip(cuts[k:end], cuts[k + 1:end + 1]):
            mine = members[ids[lo] - ids[cuts[k]]:ids[hi] - ids[cuts[k]]]
            rows.append((int(owner[lo]), pack(dst[first[lo:hi]]), pack(size[lo:hi]), pack(mine)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PIECE)], schema=_PIECE)
        k = end


def cut_lists(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Pieces of edges that come in order of (dst, src); a list is never split."""
    held, n, limit = [], 0, EDGES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(name).to_numpy(zero_copy_only=False) for name in ("src", "dst")])
        n += batch.num_rows
        if n < limit:
            continue
        src, dst = (np.concatenate(c) for c in zip(*held))
        whole = int(np.searchsorted(dst, dst[-1]))
        if whole:
            yield from _pieces(src[:whole], dst[:whole], blocks)
        held, n = [[src[whole:], dst[whole:]]], len(src) - whole
        limit = max(EDGES, 2 * n)
    if held:
        yield from _pieces(*(np.concatenate(c) for c in zip(*held)), blocks)


def _laid_out(piece: dict, block: int, blocks: int) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, 1 and their neighbour, for each member of the block and all that follow it in a list."""
    neighbours, sizes, members = (unpack(piece[name]) for name in ("neighbours", "sizes", "members"))
    at = np.flatnonzero(block_of(members, blocks) == block)
    row = np.searchsorted(np.cumsum(sizes), at, "right")
    count = np.cumsum(sizes)[row] - at - 1
    total = np.append(0, np.cumsum(count))
    k = 0
    while k < len(at):
        end = max(k + 1, int(np.searchsorted(total, total[k] + HELD, "right")) - 1)
        n = count[k:end]
        b = members[_ranges(at[k:end] + 1, n)]
        yield np.repeat(members[at[k:end]], n), b, np.ones(len(b), np.int64), np.repeat(neighbours[row[k:end]], n)
        k = end


def _folded(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row of each pair: the sum of its counts and the least of its neighbours."""
    a, b, n, chosen = (np.concatenate(c) for c in zip(*parts))
    if not len(a):
        return a, b, n, chosen
    low, high = min(int(a.min()), int(b.min())), max(int(a.max()), int(b.max()))
    span = high - low + 1
    if span < 1 << 31:
        key = (a - low) * span + (b - low)
    else:  # the ranks of ids, where a product of ids may not fit
        ids = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
        key = np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b)
    order = np.argsort(key)
    starts = _starts(key[order])
    pick = order[starts]
    return a[pick], b[pick], np.add.reduceat(n[order], starts), np.minimum.reduceat(chosen[order], starts)


def shared(pieces: Iterator[dict], block: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a block's members, each once. Pairs are folded as they grow, so that those held are distinct."""
    parts, n, limit = [], 0, HELD
    for piece in pieces:
        for part in _laid_out(piece, block, blocks):
            parts.append(part)
            n += len(part[0])
            if n >= limit:
                parts = [_folded(parts)]
                n = len(parts[0][0])
                limit = max(HELD, 2 * n)
    columns = _folded(parts) if parts else ()
    for at in range(0, len(columns[0]) if parts else 0, ROWS):
        arrays = [pa.array(c[at:at + ROWS].astype(t.type.to_pandas_dtype(), copy=False)) for c, t in zip(columns, _RESULT)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_RESULT)


def common_neighbours(edges: DataFrame) -> DataFrame:
    """a, b, common, chosen: of every pair a < b of sources with a common neighbour, how many they have in common and the
    least of them. Edges (src, dst: integers without nulls) may repeat.

    Every pair of a neighbour's sources meets, and most pairs meet once, so pairs are as many as results and a shuffle of
    them would be as large. Sources are dealt into blocks instead, of PAIRS pairs on average. A block is sent what it needs
    of each neighbour's sorted list of sources, from its first member to the end, in pieces of compressed differences, and
    lays out its own pairs and counts them where its result is. A task's memory is that of one list, or of one block's
    distinct pairs."""
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    degree = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    # Repeated edges are counted too, which makes blocks smaller, no more.
    pairs = degree.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0
    blocks = max(1, math.ceil(pairs / PAIRS))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_lists(batches, blocks)

    def lay_out(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shared((piece for batch in batches for piece in batch.to_pylist()), key[0].as_py(), blocks)

    lists = edges.repartition("dst").sortWithinPartitions("dst", "src")
    pieces = lists.mapInArrow(cut_up, "block long, neighbours binary, sizes binary, members binary")
    return pieces.groupBy("block").applyInArrow(lay_out, "a long, b long, common int, chosen long")
