"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of a test item is a possible seed. One scan of the documents finds where they occur, lines the hits
up with the item, and gives a window of the document for each place that has enough of the item's words for some
alignment to reach the bar, so a phrase that many documents and items have makes no windows; the same scan counts how
many documents hold each n-gram. A seed is rare if few documents hold it, or if it is among the rarest that its window holds, so that
every window has one, however often its passage was copied and whatever seeds the copies lost. Windows are aligned with
the item, word by word, by Smith-Waterman (match 2, mismatch -1, gap -1); the score is a share of the item's own. Edited copies lose some seeds
and some score, not all.

Test items go to the tasks in blocks of at most BLOCK_GRAMS n-grams, each block one scan; documents are never broadcast
or collected, and their texts are not shuffled, only windows are.

Cases: a null or empty text has no window; an item without words has no seed and is never found; an item shorter than
a seed has its whole sequence as its seed; a null item or document id is reported as null; rows that repeat are found
once for each id and row; long texts are scanned whole; an empty table on either side gives no rows; other columns are
kept by clean_documents and otherwise not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.session import cut

from . import common

#: Words of a seed; a seed in at most this share of all documents is rare, and so is this share of a window's own.
SEED, RARE_DOCS, RARE_OF_WINDOW = 3, 0.0005, 1 / 3
#: Smith-Waterman scores, and the share of an item's own score from which a document is contaminated.
MATCH, MISMATCH, GAP, BAR = 2, -1, -1, 0.45
#: N-grams of test items that a scan looks for at once.
BLOCK_GRAMS = 400_000
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
_MARKS = b".,;:!?\"'()[]{}|*#%$&"


def words(text: str | None) -> list[bytes]:
    """Words for alignment: white-space words without the ASCII marks around them."""
    return [w for w in (x.strip(_MARKS) for x in common.words(text)) if w]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(out) + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


class Items:
    """A block of test items with their n-grams, sorted."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.sizes = [len(ws) for _, ws in rows]
        known = common.WordHashes(REMEMBERED)
        self.words = [known.at(ws) for _, ws in rows]
        found: list[tuple[int, int, int]] = []
        self.widths = sorted({min(SEED, n) for n in self.sizes if n})
        for k, h in enumerate(self.words):
            for at, g in enumerate(grams(h, min(SEED, len(h))).tolist() if len(h) else ()):
                found.append((g, k, at))
        found.sort()
        self.keys, self.starts = np.unique(np.array([f[0] for f in found], np.uint64), return_index=True)
        self.ends = np.append(self.starts[1:], len(found)).astype(np.int64)
        self.item = np.array([f[1] for f in found], np.int64)
        self.at = np.array([f[2] for f in found], np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, place in the item, place in the text, key number) of every n-gram of a text that an item has."""
        out = []
        for width in self.widths:
            g = grams(h, width)
            at = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            good = self.keys[k] == g[at]
            for place, key in zip(at[good].tolist(), k[good].tolist(), strict=True):
                for j in range(self.starts[key], self.ends[key]):
                    out.append((int(self.item[j]), int(self.at[j]), place, key))
        return out


def _windows(hits: list[tuple[int, int, int, int]], sizes: list[int], length: int) -> Iterator[tuple[int, int, int, set[int]]]:
    """(item, start, end, key numbers): the stretches of a text in which an item may lie."""
    by: dict[int, list] = defaultdict(list)
    for item, at, place, key in hits:
        slack = sizes[item] // 3 + 3
        by[item].append((max(0, place - at - slack), min(length, place - at + sizes[item] + slack), key))
    for item, spans in by.items():
        spans.sort()
        start, end, keys = spans[0][0], spans[0][1], {spans[0][2]}
        for a, b, key in spans[1:]:
            if a <= end:
                end = max(end, b)
                keys.add(key)
            else:
                yield item, start, end, keys
                start, end, keys = a, b, {key}
        yield item, start, end, keys


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The best Smith-Waterman score of two sequences of word hashes, and where it starts and ends in the text."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        j = np.arange(len(b) + 1) * GAP
        row = np.zeros(len(b) + 1, np.int64)
        top, end = 0, 0
        for x in a:
            up = np.maximum(row + GAP, 0)
            up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
            # A run of gaps along the text: the best of all cells before, less the gaps between.
            row = np.maximum.accumulate(up - j) + j
            k = int(row.argmax())
            if row[k] > top:
                top, end = int(row[k]), k
        return top, end

    score, end = best(item, text)
    if not score:
        return 0, 0, 0
    _, back = best(item[::-1], text[:end][::-1])
    return score, end - back, end


def most(item: np.ndarray, text: np.ndarray) -> int:
    """A score that no alignment of the two exceeds: each match takes a word of either that the other has too."""
    return MATCH * int(min(np.isin(item, text).sum(), np.isin(text, item).sum()))


def _found(spark: SparkSession, docs: DataFrame, items: Items) -> DataFrame:
    """row_key, doc_id, item_id, score, start, end, seeds of the documents that hold an item of a block."""
    sent = spark.sparkContext.broadcast(items)

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        block, known = sent.value, common.WordHashes(REMEMBERED)
        names = ("row_key", "doc_id", "item", "start", "keys", "window", "held")
        seen: Counter = Counter()
        for b in batches:
            out: dict = {k: [] for k in names}
            for row, doc, text in zip(b["row_key"], b["doc_id"], b["text"], strict=True):
                h = known.at(words(text))
                hits = block.hits(h)
                seen.update({hit[3] for hit in hits})
                for item, start, end, keys in _windows(hits, block.sizes, len(h)) if hits else ():
                    # Too few of the item's words for any alignment to reach the bar: no window.
                    if most(block.words[item], h[start:end]) < BAR * MATCH * block.sizes[item]:
                        continue
                    for k, v in zip(names, (row, doc, item, start, sorted(keys), h[start:end].tobytes(), None), strict=True):
                        out[k].append(v)
            yield out
        # Last, in how many of the task's documents each n-gram was found: at most as many rows as the block has n-grams.
        yield {k: [None] * len(seen) for k in names} | {"keys": [[k] for k in seen], "held": list(seen.values())}

    schema = "row_key string, doc_id long, item int, start long, keys array<int>, window binary, held long"
    found = cut(common.arrow_map(docs.select("row_key", "doc_id", "text"), scan, schema))
    n = docs.count()
    # At most BLOCK_GRAMS rows: how many documents hold each n-gram.
    held = found.where("held IS NOT NULL").groupBy(F.col("keys")[0].alias("key")).agg(F.sum("held").alias("n")).collect()
    df = np.zeros(len(items.keys), np.int64)
    for r in held:
        df[r["key"]] = r["n"]
    df_sent = spark.sparkContext.broadcast(df)

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        block, held_by = sent.value, df_sent.value
        for b in batches:
            out: dict = {k: [] for k in ("row_key", "doc_id", "item_id", "score", "start", "stop", "seeds")}
            for row, doc, item, start, keys, window in zip(*(b[k] for k in ("row_key", "doc_id", "item", "start", "keys", "window")), strict=True):
                seeds = max(int((held_by[keys] <= RARE_DOCS * n).sum()), int(np.ceil(len(keys) * RARE_OF_WINDOW)))
                text = np.frombuffer(window, np.uint64)
                s, a, e = align(block.words[item], text)
                share = s / (MATCH * block.sizes[item])
                if share >= BAR:
                    for k, v in zip(out, (row, doc, block.ids[item], share, start + a, start + e, seeds), strict=True):
                        out[k].append(v)
            yield out

    return common.arrow_map(found.where("held IS NULL"), score, "row_key string, doc_id long, item_id long, score double, start long, stop long, seeds int")


def row_key():
    """A 128-bit hash of id and text, so that no clean document is taken for a found one."""
    return F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_key, doc_id, item_id, score, start, stop, seeds: for each document and item found in it, the best place.

    row_key is a 128-bit hash of id and text; start and stop count the document's words.
    """
    keyed = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row_key string, doc_id long, item_id long, score double, start long, stop long, seeds int"
    # The items stream to the driver; a block of them is held at a time.
    block_rows: list[tuple[int | None, list[bytes]]] = []
    found: list[DataFrame] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
        ws = words(r["text"])
        if size + len(ws) > BLOCK_GRAMS and block_rows:
            found.append(_found(spark, keyed, Items(block_rows)))
            block_rows, size = [], 0
        if ws:
            block_rows.append((r["item_id"], ws))
            size += len(ws)
    if block_rows:
        found.append(_found(spark, keyed, Items(block_rows)))
    if not found:
        return spark.createDataFrame([], schema)
    out = reduce(DataFrame.unionByName, found)
    best = out.groupBy("row_key", "doc_id", "item_id").agg(F.max(F.struct("score", "seeds", (-F.col("start")).alias("before"), "stop")).alias("b"))
    return best.select("row_key", "doc_id", "item_id", "b.score", (-F.col("b.before")).alias("start"), "b.stop", "b.seeds")


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no test item. Spark broadcasts the found keys only if they are few."""
    found = cut(contaminated(spark, docs, benchmark).select("row_key").distinct())
    # The key is an expression of the join, and its name is none of the caller's.
    name = common.free_name(docs, "row_key")
    return docs.join(found.toDF(name), row_key() == F.col(name), "left_anti")
