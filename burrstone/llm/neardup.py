"""Near-duplicate documents by a multi-index Hamming join of minhash signatures, confirmed on full shingle sets.

A signature has SYMBOLS b-bit symbols (b = 64), the minima of as many hash functions over the shingle set. Its first
CHUNKS * WIDTH symbols are the index: chunks of WIDTH symbols, in each of which one symbol may differ. The allowed
errors are enumerated as the WIDTH ways to leave one symbol out; documents that agree in what is left share a key.
By the pigeonhole principle all pairs whose signatures differ in at most 2 * CHUNKS - 1 index symbols share a key; at
similarity 0.8 the others share one with probability above 1 - 3e-5. Four bits of every symbol are kept apart as planes;
the signature distance of a pair is the number of symbols that differ there, and pairs further apart than FAR are not
looked at (at similarity 0.8: 2 in 10**7, the binomial tail). What is left is confirmed on the full sets.

Pairs of a bucket are never listed. Equal sets are one class, only its least id takes part. The pivot of a bucket is
its member with the most company in all its buckets, which is the middle of a group of copies; the buckets of one pivot
are one group. Every member is compared with its pivots, and the links found are contracted to components. Members that
are not in the component of their pivot are strays; only they are compared with the group's members of other components,
so every pair that shares a key is either compared or already connected. Strays and members of a group are cut into a
grid of cells of bounded size; each pair meets in one cell, whatever the size of the group, and a cell gives back which
members matter, or links that join components, never its pairs.

Cases: a document without words or with null text has no shingles and is linked with nothing; one with fewer words
than a shingle has its whole sequence as its only shingle; a null id is never linked, its component is null and it is
kept; rows that repeat an id and a text get the same answer; an empty table gives no rows; other columns are not read;
whole texts are shingled, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.operators.components import components
from burrstone.session import cut

from . import common

SYMBOLS, CHUNKS, WIDTH = 128, 8, 5
#: Bits kept of each symbol, the longs that hold them, and the distance: symbols in which those of a pair may differ.
BITS, PLANES, FAR = 4, 4 * SYMBOLS // 64, 48
#: Members of a pivot that are compared in one group.
BLOCK = 256
#: Members on either side of a cell in which signatures meet.
MET = 4096
#: Members, and shingles, on either side of a cell in which sets meet, about.
CELL, CELL_SHINGLES = 512, 200_000
#: Bits of the map of wanted ids.
MARKS = 1 << 22
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
#: Odd multipliers of the hash functions, from a fixed seed.
_MULTIPLIERS = np.random.default_rng(20240501).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size, self.known = size, common.WordHashes(REMEMBERED)

    def set_of(self, text: str | None) -> np.ndarray:
        h = self.known.at(common.words(text))
        if not len(h):
            return h
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of SYMBOLS hash functions over a set that is not empty."""
    best = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        best = np.minimum(best, (s[k : k + 2048, None] * _MULTIPLIERS[None, :]).min(0))
    return _mix(best)


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """CHUNKS * WIDTH keys of each signature: for each chunk and each symbol that may differ, a hash of the others."""
    grid = sigs[:, : CHUNKS * WIDTH].reshape(len(sigs), CHUNKS, WIDTH)
    keys = []
    for left_out in range(WIDTH):
        k = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out + 1), grid.shape[:2])
        for i in range(WIDTH):
            if i != left_out:
                k = _mix(k ^ grid[:, :, i])
        keys.append(k)
    return np.concatenate(keys, axis=1)


def planes(sigs: np.ndarray) -> np.ndarray:
    """PLANES longs of each signature: for each 64 symbols, BITS longs with one bit of every symbol."""
    bits = [np.packbits(((sigs >> np.uint64(k)) & np.uint64(1)).astype(np.uint8), axis=1).view(">i8") for k in range(BITS)]
    return np.stack(bits, axis=2).reshape(len(sigs), PLANES).astype(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, set_hi, set_lo, keys, planes of every row. No text leaves its task."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler(size)
        for b in batches:
            sets = [shingler.set_of(t) for t in b["text"]]
            n = np.array([len(s) for s in sets], np.int64)
            ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            keys: list = [[]] * len(sets)
            bits = np.zeros((len(sets), PLANES), np.int64)
            full = np.flatnonzero(n)
            if len(full):
                sigs = np.stack([signature(sets[i]) for i in full])
                bits[full] = planes(sigs)
                for i, k in zip(full.tolist(), index_keys(sigs).view(np.int64), strict=True):
                    keys[i] = k
            yield {"doc_id": b["doc_id"], "n": n, "set_hi": ids[:, 0], "set_lo": ids[:, 1], "keys": keys} | {f"p{k}": bits[:, k] for k in range(PLANES)}

    return common.arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, n long, set_hi long, set_lo long, keys array<long>, " + ", ".join(f"p{k} long" for k in range(PLANES)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, shingles: the full sets of the documents whose id is wanted.

    A bitmap of MARKS hashed ids, of one size whatever the input, goes to the scan; texts whose id it does not hold are
    passed over there, so sets are shuffled and texts are not. The join with the ids then is exact.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    mark = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(MARKS)).cast("int")
    held = wanted.select(F.pmod(F.xxhash64(F.col("id")), F.lit(MARKS)).cast("int").alias("mark")).distinct().toPandas()["mark"].to_numpy()
    bits = np.zeros(MARKS, bool)
    bits[held] = True
    sent = spark.sparkContext.broadcast(np.packbits(bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(size), np.unpackbits(sent.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(known[b.column(2).to_numpy(zero_copy_only=False)]))
            sets = [shingler.set_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], names=["id", "which", "shingles"])

    found = docs.select("doc_id", "text", mark.alias("mark")).where("doc_id IS NOT NULL").mapInArrow(rows, "id long, which long, shingles array<long>")
    # Rows that repeat an id and a text give one set; an id with several texts has several, any of which may link it.
    return found.join(wanted, "id", "left_semi").dropDuplicates(["id", "which"]).select("id", "shingles")


#: Columns that say how similar two documents can be.
_FACTS = ["n", *[f"p{k}" for k in range(PLANES)]]


def _star_links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (pivot, id) that are links, by their full sets. A set goes once to each pivot of its document, and a
    pivot's set once to each block of its members, so a large group is many small ones."""
    pairs = cut(pairs)
    wanted = cut(pairs.select("id").union(pairs.select("pivot")).distinct())
    sets = cut(shingle_sets(docs, wanted, size))
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocked = pairs.join(counts, "pivot").select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    left = blocked.join(sets, "id").select("pivot", "block", "id", "shingles")
    right = counts.join(sets, counts["pivot"] == sets["id"]).select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("shingles").alias("of_pivot")
    )
    both = F.size(F.array_intersect("shingles", "of_pivot"))
    joined = left.join(right, ["pivot", "block"]).select("pivot", "id", both.alias("common"), (F.size("shingles") + F.size("of_pivot")).alias("sum"))
    return joined.where(F.col("common") * 100 >= (F.col("sum") - F.col("common")) * percent).select("pivot", "id").distinct()


def _near(percent: int, a: str = "", b: str = "o_"):
    """Whether a pair is within the signature distance, and its sizes let it be similar; its facts have the prefixes a and b."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    differ = F.lit(0)
    for start in range(0, PLANES, BITS):
        any_bit = F.lit(0).cast("long")
        for k in range(start, start + BITS):
            any_bit = any_bit.bitwiseOR(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}")))
        differ = differ + F.bit_count(any_bit)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= FAR)


def _members(reps: DataFrame) -> DataFrame:
    """(pivot, id): for each bucket of several members its pivot with each of them; buckets of one pivot are one group.

    Only keys and ids are shuffled for it, and buckets are counted before the shuffle, so one that holds a third of all
    documents is no large group."""
    rows = reps.select(F.explode("keys").alias("key"), "id")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    held = cut(rows.join(counts.select("key", "members"), "key"))
    company = held.groupBy("id").agg(F.sum("members").alias("company"))
    members = held.select("key", "id").join(company, "id")
    best = members.groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"))).alias("p"))
    return members.join(best.select("key", (-F.col("p.minus")).alias("pivot")), "key").select("pivot", "id").distinct()


def _star_pairs(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(pivot, id) for members within the signature distance of their pivot."""
    of_pivot = facts.select(F.col("id").alias("pivot"), *[F.col(c).alias(f"o_{c}") for c in _FACTS])
    return members.where("id <> pivot").join(facts, "id").join(of_pivot, "pivot").where(_near(percent)).select("pivot", "id")


def _grid(strays: DataFrame, others: DataFrame, side: int, shingles: int) -> tuple[DataFrame, DataFrame]:
    """Both with the cells row and col: each stray of a group meets each of its others in exactly one cell, and a cell
    has about side members, or that many shingles, on either side."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        need = F.greatest(F.ceil(F.count(F.lit(1)) / side), F.ceil(F.sum("n") / shingles)).cast("int")
        return df.groupBy("pivot").agg(need.alias(name))

    sizes = blocks(strays, "rows").join(blocks(others, "cols"), "pivot")
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = strays.join(sizes, "pivot").withColumn("row", mine("rows")).withColumn("col", upto("cols")).drop("rows", "cols")
    b = others.join(sizes, "pivot").withColumn("col", mine("cols")).withColumn("row", upto("rows")).drop("rows", "cols")
    return a, b


def _stray_links(members: DataFrame, facts: DataFrame, comp: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(pivot, id): links between the strays of a group and its members of other components, as far as they join components.

    Pairs are never rows. Two semi-joins of the grid's cells keep the members that have anyone of another component
    within the signature distance; then their sets meet in smaller cells, which give spanning links only."""
    lead = comp.select(F.col("id").alias("pivot"), F.col("component").alias("lead"))
    marked = (
        members.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")).join(lead, "pivot", "left")
        .withColumn("stray", F.col("component") != F.coalesce("lead", "pivot")).drop("lead")
    )
    mixed = marked.groupBy("pivot").agg(F.count_if("stray").alias("strays")).where("strays > 0").select("pivot")
    held = cut(marked.join(mixed, "pivot").join(facts, "id"))

    strays, others = _grid(held.where("stray"), held, MET, 1 << 40)
    renamed = others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns])
    meets = [F.col(c) == F.col(f"o_{c}") for c in ("pivot", "row", "col")] + [F.col("component") != F.col("o_component"), _near(percent)]
    kept = ["pivot", "id", "component", "n"]
    a = cut(strays.join(renamed, meets, "left_semi").select(*kept).distinct())
    renamed = strays.select(*[F.col(c).alias(f"o_{c}") for c in strays.columns])
    b = cut(others.join(renamed, meets, "left_semi").select(*kept).distinct())

    sets = cut(shingle_sets(docs, cut(a.select("id").union(b.select("id")).distinct()), size))
    strays, others = _grid(a, b, CELL, CELL_SHINGLES)
    both = strays.withColumn("stray", F.lit(True)).unionByName(others.withColumn("stray", F.lit(False))).join(sets, "id")
    both = both.select("pivot", "row", "col", "stray", "id", "component", "shingles")
    return both.groupBy("pivot", "row", "col").applyInArrow(lambda t: _cell_links(t, percent), "pivot long, id long")


def _cell_links(cell, percent: int):
    """Links of a cell that join components, by exact sizes of intersections: no more than there are members."""
    import pyarrow as pa

    side, ids, component = (cell.column(c).to_numpy() for c in ("stray", "id", "component"))
    side = side.astype(bool)
    lists = cell.column("shingles").combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(lists.value_lengths(), np.int64))
    size = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(ids)), size)
    at = np.empty(len(ids), np.int64)  # the place of each row on its side
    at[side], at[~side] = np.arange(side.sum()), np.arange((~side).sum())
    # Only shingles of both sides count; a slice of them at a time is a pair of 0-1 matrices.
    left = side[row]
    names = np.intersect1d(flat[left], flat[~left])
    k = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
    shared = (names[k] == flat) if len(names) else np.zeros(len(flat), bool)
    order = np.argsort(k[shared], kind="stable")
    k, row = k[shared][order], row[shared][order]
    common = np.zeros((int(side.sum()), int((~side).sum())), np.float32)
    for start in range(0, len(names), 2048):
        lo, hi = np.searchsorted(k, [start, start + 2048])
        part, of = k[lo:hi] - start, row[lo:hi]
        m = [np.zeros((n, 2048), np.float32) for n in common.shape]
        for which, mat in ((True, m[0]), (False, m[1])):
            sel = side[of] == which
            mat[at[of[sel]], part[sel]] = 1
        common += m[0] @ m[1].T
    total = size[side][:, None] + size[~side][None, :] - common
    hit = (common * 100 >= total * percent) & (component[side][:, None] != component[~side][None, :])
    a, b = np.nonzero(hit)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    pairs = zip(ids[side][a].tolist(), component[side][a].tolist(), ids[~side][b].tolist(), component[~side][b].tolist(), strict=True)
    for i, of_i, j, of_j in pairs:
        if (x := root(of_i)) != (y := root(of_j)):
            parent[x] = y
            out.append((i, j))
    return pa.table({"pivot": pa.array([x for x, _ in out], pa.int64()), "id": pa.array([y for _, y in out], pa.int64())})


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least id that links reach) and kept, for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = cut(signatures(docs, size))
    # One representative for each class of equal sets; equal sets have equal keys.
    classes = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_hi", "set_lo").agg(
        F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in (*_FACTS, "keys")]
    )
    reps = cut(classes)
    facts = reps.select("id", *_FACTS)
    members = cut(_members(reps))
    links = cut(_star_links(_star_pairs(members, facts, percent), docs, size, percent))
    comp = cut(components(links, "pivot", "id"))
    more = cut(_stray_links(members, facts, comp, docs, size, percent))
    comp = cut(components(links.unionByName(more), "pivot", "id"))
    member = reps.select("set_hi", "set_lo", "id").join(comp, "id", "left").select(
        F.col("set_hi").alias("__hi"), F.col("set_lo").alias("__lo"), F.coalesce("component", "id").alias("__component")
    )
    rows = sig.select("doc_id", "n", "set_hi", "set_lo")
    out = rows.join(member, (rows["set_hi"] == member["__hi"]) & (rows["set_lo"] == member["__lo"]) & (rows["n"] > 0), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("__component", "doc_id")).cast("long")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, less those that are not the first of their component. Spark broadcasts the ids
    that go only if they are few; rows with a null id stay."""
    gone = cut(near_duplicates(spark, docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
