"""Line dedup by sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at both ends, A-Z lower-cased; its identity is a 128-bit hash. The
reference counts say in how many documents (rows) each key is found; they are exact, and adding or removing documents
adds or subtracts counts, so dedup is reversible. Keys at or above a limit are members: each shard of them is a cuckoo
filter (16-bit fingerprints, four to a bucket), which takes insertions and deletions as members come and go.

To clean documents, the filters are sent to every task together with the exact list of corpus keys that the filters
hold wrongly (every corpus key has a reference count, so the list is found by probing all of them). One scan without a
shuffle of texts then decides every line exactly. If filters and list exceed SENT_BYTES, the keys of the lines go to the
filters instead: each shard's filter meets the keys of its shard, in blocks of about PROBED, and the few that pass are
joined with the members, which settles the wrong ones; verdicts join the documents by text hash. Both ways give the same
rows.

Cases: a null or empty text is one empty line; keys shorter than min_chars are never members; rows that repeat are
documents of their own, also with equal ids; null ids stay null; an empty table gives no rows; other columns are kept
by clean_documents as they are; texts of any length are split whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Filters and their list of wrong members are broadcast up to this size.
SENT_BYTES = 64 << 20
#: Keys that a task counts before it hands them on.
COUNTED = 100_000
#: Keys of lines that meet a shard's filter in one group, about.
PROBED = 500_000
#: Members in a shard of the filters, about.
SHARD_KEYS = 1 << 18


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def key_of(line: str) -> str:
    line = line.strip(common.SPACE)
    return line.lower() if line.isascii() else line.translate(common.LOWER)


def digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


class CuckooFilter:
    """Cuckoo filter over 64-bit hashes: 16-bit fingerprints, four slots to a bucket, partial-key displacement."""

    SLOTS = 4

    def __init__(self, expected: int):
        buckets = 1
        while buckets * self.SLOTS * 0.9 < max(1, expected):
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(0)
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (h >> np.uint64(48)).astype(np.uint64)
        mark = np.where(mark == 0, np.uint64(1), mark)
        first = h & mask
        return mark.astype(np.uint16), first.astype(np.int64), (first ^ (mark * np.uint64(0x5BD1E995) & mask)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, bool)
        mark, a, b = self._places(h)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, h: int) -> bool:
        """False if no slot was found after many moves; the caller then builds a larger filter from the exact counts."""
        mark, a, b = (x[0] for x in self._places(np.array([h], np.uint64)))
        mask = len(self.table) - 1
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = int(a)
        for k in range(500):
            slot = k % self.SLOTS
            self.table[at, slot], mark = mark, self.table[at, slot]
            at ^= (int(mark) * 0x5BD1E995) & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, h: int) -> bool:
        mark, a, b = (x[0] for x in self._places(np.array([h], np.uint64)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        size = len(hashes)
        while True:
            out = cls(size)
            if all(out.insert(int(h)) for h in hashes):
                return out
            size = 2 * max(size, 2)


def signed_counts(docs: DataFrame, min_chars: int = 1, sign: int = 1) -> DataFrame:
    """hi, lo, n: for each key, the documents that hold it, times sign. Each task counts before it shuffles."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        counts: Counter = Counter()

        def give() -> dict:
            ds = np.frombuffer(b"".join(counts), dtype="<i8").reshape(-1, 2)
            return {"hi": ds[:, 0], "lo": ds[:, 1], "n": [sign * n for n in counts.values()]}

        for b in batches:
            for text in b["text"]:
                keys = {key_of(x) for x in lines_of(text)}
                counts.update(digest(k) for k in keys if len(k) >= min_chars)
            if len(counts) >= COUNTED:
                yield give()
                counts.clear()
        if counts:
            yield give()

    return common.arrow_map(docs.select("text"), rows, "hi long, lo long, n long")


def reference_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The exact table: hi, lo, n."""
    return signed_counts(docs, min_chars).groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def updated_counts(counts: DataFrame, docs: DataFrame, removed: bool, min_chars: int = 1) -> DataFrame:
    """The exact table after documents were added or removed; keys of no document leave it."""
    delta = signed_counts(docs, min_chars, -1 if removed else 1)
    return counts.unionByName(delta).groupBy("hi", "lo").agg(F.sum("n").alias("n")).where("n > 0")


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col("lo"), F.lit(shards)).cast("int"))


def build_filters(members: DataFrame, shards: int) -> DataFrame:
    """shard, n, filter: one cuckoo filter for each shard of the members (hi, lo)."""

    def build(pdf):
        import pandas as pd

        made = CuckooFilter.build(pdf["hi"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "filter": [made.to_bytes()]})

    return _sharded(members.select("hi", "lo"), shards).groupBy("shard").applyInPandas(build, "shard int, n long, filter binary")


def updated_filters(filters: DataFrame, joined: DataFrame, left: DataFrame, shards: int) -> DataFrame:
    """The filters after some keys became members and others left. Only shards with changes are touched; one that
    overflows is reported with a null filter and is built again from the exact counts."""
    changes = _sharded(joined.select("hi", "lo"), shards).withColumn("add", F.lit(True)).unionByName(
        _sharded(left.select("hi", "lo"), shards).withColumn("add", F.lit(False))
    )

    def apply(key, old, new):
        import pandas as pd

        f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(max(64, 2 * len(new)))
        n, good = int(old["n"].iloc[0]) if len(old) else 0, True
        for h, add in sorted(zip(new["hi"].to_numpy().view(np.uint64).tolist(), new["add"].tolist(), strict=True), key=lambda x: x[1]):
            good = (f.insert(h) if add else f.delete(h)) and good
            n += 1 if add else -1
        return pd.DataFrame({"shard": [key[0]], "n": [n], "filter": [f.to_bytes() if good else None]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, "shard int, n long, filter binary")


class Verdicts:
    """What decides a line: filters by shard, less the keys that they hold wrongly."""

    def __init__(self, shards: int, filters: dict[int, bytes], wrong: set[bytes]):
        self.shards, self.raw, self.wrong = shards, filters, wrong
        self._made: dict[int, CuckooFilter] | None = None

    def __getstate__(self):
        return (self.shards, self.raw, self.wrong)

    def __setstate__(self, state):
        self.shards, self.raw, self.wrong = state
        self._made = None

    def held(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether the filters hold each key."""
        if self._made is None:
            self._made = {k: CuckooFilter.from_bytes(v) for k, v in self.raw.items()}
        out = np.zeros(len(hi), bool)
        shard = np.mod(lo, self.shards)
        for k in np.unique(shard):
            if int(k) in self._made:
                at = np.flatnonzero(shard == k)
                out[at] = self._made[int(k)].contains(hi[at].view(np.uint64))
        return out

    def members(self, digests: list[bytes]) -> list[bool]:
        if not digests:
            return []
        ds = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        held = self.held(np.ascontiguousarray(ds[:, 0]), np.ascontiguousarray(ds[:, 1])).tolist()
        return [h and d not in self.wrong for h, d in zip(held, digests, strict=True)]


@dataclass
class Learned:
    """What decides lines: the exact counts, the members among them, their filters by shard and, if all of it is small
    enough to be sent, the verdicts."""

    counts: DataFrame
    members: DataFrame
    filters: DataFrame
    shards: int
    verdicts: Verdicts | None = None


def learn(spark: SparkSession, docs: DataFrame, min_docs: int, min_chars: int) -> Learned:
    """Counts, members and filters of a corpus."""
    from burrstone.session import cut

    counts = cut(reference_counts(docs, min_chars))
    members = counts.where(F.col("n") >= min_docs).select("hi", "lo")
    n = members.count()
    shards = max(1, -(-n // SHARD_KEYS))
    learned = Learned(counts, members, cut(build_filters(members, shards)), shards)
    # A filter takes 2 bytes a slot and is at least 45 % full.
    if n * 4.5 > SENT_BYTES:
        return learned
    verdicts = Verdicts(shards, {r["shard"]: bytes(r["filter"]) for r in learned.filters.collect()}, set())
    sent = spark.sparkContext.broadcast(verdicts)

    def wrong(batches):
        for b in batches:
            hi, lo = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield b.filter(_mask(sent.value.held(hi, lo)))

    rest = counts.where(F.col("n") < min_docs).select("hi", "lo").mapInArrow(wrong, "hi long, lo long")
    most = int((SENT_BYTES - n * 4.5) // 100)
    rows = rest.limit(most + 1).collect()
    if len(rows) <= most:
        verdicts.wrong = {np.array([r["hi"], r["lo"]], dtype="<i8").tobytes() for r in rows}
        learned.verdicts = verdicts
    return learned


def _mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep, type=pa.bool_())


def _kept(text: str | None, min_chars: int, drops) -> tuple[int, list[str]]:
    """Lines of a text and those that stay; drops takes digests and says which are members."""
    lines = lines_of(text)
    keys = [key_of(x) for x in lines]
    asked = [k for k, x in enumerate(keys) if len(x) >= min_chars]
    gone = {k for k, m in zip(asked, drops([digest(keys[k]) for k in asked]), strict=True) if m}
    return len(lines), [x for k, x in enumerate(lines) if k not in gone]


def clean_documents(
    spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
    extra=None, extra_schema: str = "",
) -> DataFrame:
    """docs with text cut to the lines that stay and, with extra, columns made of (lines before, lines kept, text)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    learned = learn(spark, docs, min_docs, min_chars)
    added = _parse_datatype_string(extra_schema) if extra_schema else StructType([])
    schema = StructType(list(docs.schema.fields) + list(added.fields))
    arrow = to_arrow_schema(schema)
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches, drops_of):
        for b in batches:
            texts, more = [], {f.name: [] for f in added.fields}
            for text, drops in zip(b.column(at).to_pylist(), drops_of(b), strict=True):
                n, kept = _kept(text, min_chars, drops)
                # A text that loses nothing stays as it is, null included.
                texts.append("\n".join(kept) if len(kept) < n else text)
                for k, v in (extra(n, len(kept), "\n".join(kept)) if extra else {}).items():
                    more[k].append(v)
            columns = [pa.array(texts, type=arrow.field(at).type) if i == at else b.column(i).cast(arrow.field(i).type) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(more[f.name], type=arrow.field(f.name).type) for f in added.fields], schema=arrow)

    if learned.verdicts is not None:
        sent = spark.sparkContext.broadcast(learned.verdicts)
        return docs.mapInArrow(lambda batches: run(batches, lambda b: [sent.value.members] * b.num_rows), schema)

    return _joined(docs, learned, min_chars, schema, run)


def _passed(keys: DataFrame, learned: Learned) -> DataFrame:
    """The keys (th, hi, lo) that their shard's filter holds. A shard with a very common line is many groups."""

    def probe(held, asked):
        f = CuckooFilter.from_bytes(held.column("filter")[0].as_py()) if held.num_rows else None
        good = f.contains(asked.column("hi").to_numpy().view(np.uint64)) if f else np.zeros(asked.num_rows, bool)
        return asked.select(["th", "hi", "lo"]).filter(_mask(good))

    blocks = F.ceil(F.sum("n") / PROBED).cast("int").alias("blocks")
    sizes = _sharded(learned.counts, learned.shards).groupBy("shard").agg(blocks)
    asked = _sharded(keys, learned.shards).join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
    held = learned.filters.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "filter")
    return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(probe, "th string, hi long, lo long")


def _joined(docs: DataFrame, learned: Learned, min_chars: int, schema, run) -> DataFrame:
    """The way for filters too large to be sent: keys of lines meet the filters by shard, those that pass join the
    members, and verdicts join documents by text hash."""

    def lines(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"th": [], "hi": [], "lo": []}
            for th, text in zip(b["th"], b["text"], strict=True):
                found = {digest(k) for k in map(key_of, lines_of(text)) if len(k) >= min_chars}
                ds = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                out["th"].extend([th] * len(ds))
                out["hi"].extend(ds[:, 0].tolist())
                out["lo"].extend(ds[:, 1].tolist())
            yield out

    hashed = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    texts = docs.select(hashed.alias("th"), "text")
    # One key is in many documents, but members are distinct: adaptive execution splits the large side of a hot key.
    keys = common.arrow_map(texts, lines, "th string, hi long, lo long").distinct()
    hits = _passed(keys, learned).join(learned.members, ["hi", "lo"])
    th, list_ = common.free_name(docs, "th"), common.free_name(docs, "gone")
    gone = hits.groupBy("th").agg(F.collect_list(F.struct("hi", "lo"))).toDF(th, list_)
    joined = docs.join(gone, hashed == F.col(th), "left").drop(th)
    width = len(docs.columns)

    def drops_of(b):
        for gone in b.column(width).to_pylist():
            keys = {np.array([g["hi"], g["lo"]], dtype="<i8").tobytes() for g in gone or ()}
            yield lambda ds, keys=keys: [d in keys for d in ds]

    return joined.mapInArrow(lambda batches: run(batches, drops_of), schema)


def digest_rows(spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for every document."""
    import hashlib

    def extra(n: int, kept: int, text: str) -> dict:
        return {"n_lines": n, "n_dropped": n - kept, "kept_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}

    cleaned = clean_documents(spark, docs.select("doc_id", "text"), min_docs, min_chars, extra, "n_lines long, n_dropped long, kept_sha256 string")
    return cleaned.select("doc_id", "n_lines", "n_dropped", "kept_sha256")
