"""Deleted-interpolation language model over word n-grams.

P(w | u) = l(b) * c(u, w) / c(u) + (1 - l(b)) * P1(w), b the bucket of the context count c(u) by powers of two, and
P1(w) = m * c(w) / N + (1 - m) / (V + 1); a context never seen gives P1. Part of the training documents (a fold of
their ids) is held out: with counts of the others, expectation-maximisation on the held-out tokens learns m and one
l for each bucket. Scores then use the counts of all training documents.

Layout. Tokens become 64-bit hashes, bigrams a mix of two. Each task cuts its documents into chunks and sends, for
each chunk and bucket of the hash space, the sorted distinct n-grams with their counts as packed binary columns; a
bucket adds them up and sends each chunk the totals of what it asked for. A chunk then has every count that its tokens
need, so neither a vocabulary nor a count table is ever broadcast or collected, and a frequent word costs one entry
for each chunk. Learning needs only the held-out chunks; its cells (bucket, ratio of the two estimates in steps) are
bounded and go to the driver.

Cases: a null or empty text is the end token alone; a null id is the empty id and counts as training; rows that repeat
are scored and counted each; with no training rows every count is 0 and every token has probability 1; texts of any
length are scored whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens of a chunk, about; and words whose hashes a task remembers.
CHUNK_TOKENS, REMEMBERED = 2_000_000, 150_000
#: Buckets of the hash space for each partition of the input: a task adds up one at a time.
BUCKETS = 4
#: Fixed hashes of the end token and of the context before the first word.
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
#: Buckets of context counts (powers of two) and steps to a unit of the logarithm of the ratio of the estimates.
CONTEXT_BUCKETS, STEPS = 48, 32
#: Kinds of chunks: counted training text, held-out training text for the weights, and text never learned from.
TRAIN, TUNE, TEST = 0, 1, 2


def token_hashes(text: str | None, known: common.WordHashes) -> np.ndarray:
    """Hashes of the words and the end token."""
    return np.append(known.at(common.words(text)), END)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of the bigram; never that of a word but by chance of 2**-64."""
    h = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x165667B19E3779F9) + (u >> np.uint64(29)))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Chunk:
    """Documents of one kind: their ids, token counts, and tokens as codes of the chunk's own vocabulary."""

    number: int
    kind: int
    ids: list
    sizes: np.ndarray
    codes: np.ndarray
    vocab: np.ndarray

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct n-gram hashes, their counts, and the places of each token's word, context and bigram there.

        The first places are the chunk's words, then the start context, then bigrams, before sorting.
        """
        import pandas as pd

        v = len(self.vocab)
        starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        context = np.empty_like(self.codes)
        context[1:] = self.codes[:-1]
        context[starts] = v
        hashes = np.append(self.vocab, START)
        pair, distinct = pd.factorize(context.astype(np.int64) * v + self.codes)
        keys = np.concatenate([hashes, pair_hash(hashes[distinct // v], hashes[distinct % v])])
        # The start context counts once for each document; the end token is never a context.
        counts = np.concatenate([np.bincount(self.codes, minlength=v), [len(self.sizes)], np.bincount(pair, minlength=len(distinct))])
        order = np.argsort(keys, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return keys[order], counts[order], place[self.codes], place[context], place[v + 1 + pair]


def chunks_of(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...] = (TRAIN, TUNE, TEST)) -> Iterator[Chunk]:
    """Cut a partition (doc_id, kind, text) into chunks of one of the kinds each. Rows of a kind are cut alike whatever
    rows of other kinds stand between them, so a scan that passes those over gives the same chunks. They are passed over
    here and not by a filter, which Catalyst would push below a shuffle of the input and so change its partitions."""
    import pandas as pd
    from pyspark import TaskContext

    base, known = TaskContext.get().partitionId() << 32, common.WordHashes(REMEMBERED)
    made, open_ = Counter(), {}

    def close(kind: int) -> Chunk:
        ids, tokens, _ = open_.pop(kind)
        codes, vocab = pd.factorize(np.concatenate(tokens))
        made[kind] += 1
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        return Chunk(base + (kind << 28) + made[kind], kind, ids, sizes, codes, vocab)

    for b in batches:
        b = b.filter(pa.array(np.isin(b.column(1).to_numpy(zero_copy_only=False), kinds)))
        for doc, kind, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held = open_.setdefault(kind, [[], [], 0])
            t = token_hashes(text, known)
            held[0].append(doc)
            held[1].append(t)
            held[2] += len(t)
            if held[2] >= CHUNK_TOKENS:
                yield close(kind)
    for kind in list(open_):
        yield close(kind)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash space starts among sorted keys."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the first, then the gaps in the fewest whole bytes that hold them all."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    width, first = raw[0], np.frombuffer(raw, "<u8", 1, 1)
    gaps = np.frombuffer(raw, np.uint8, -1, 9).reshape(-1, width)
    wide = np.zeros((len(gaps), 8), np.uint8)
    wide[:, :width] = gaps
    return np.cumsum(np.concatenate([first, wide.view("<u8").ravel()]), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    most = int(counts.max()) if len(counts) else 0
    kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"
    return bytes([int(kind[2])]) + counts.astype(kind).tobytes()


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", -1, 1).astype(np.int64)


_ASK = "chunk long, kind int, bucket int, keys binary, counts binary"
_GIVEN = "chunk long, kind int, bucket int, counted binary, tuned binary, n_words long, n_tokens long, n_words_all long, n_tokens_all long"


def _schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)


def gram_totals(rows: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket, the totals of the chunk's n-grams there over counted and over tuning text, in the
    order of the chunk's sorted keys. Row (-1, bucket) has the bucket's share of V and N instead."""
    ask, given = _schema(_ASK), _schema(_GIVEN)

    def send(batches):
        for c in chunks_of(batches):
            keys, counts, wi, *_ = c.grams()
            at = _bounds(keys, buckets)
            # Words are told from bigrams by a mark in the counts' lowest bit, for V and N.
            marked = counts * 2
            marked[wi] |= 1
            for k in np.flatnonzero(np.diff(at)):
                i, j = at[k], at[k + 1]
                yield _rows([(c.number, c.kind, int(k), _pack_keys(keys[i:j]), _pack_counts(marked[i:j]))], ask)

    def add(pdf):
        import pandas as pd

        parts = [_unpack_keys(x) for x in pdf["keys"]]
        marked = [_unpack_counts(x) for x in pdf["counts"]]
        sizes = [len(x) for x in parts]
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        both = np.concatenate(marked)
        kind = np.repeat(pdf["kind"].to_numpy(), sizes)
        n = both >> 1
        counted = np.bincount(inverse, weights=n * (kind == TRAIN), minlength=len(keys)).astype(np.int64)
        tuned = np.bincount(inverse, weights=n * (kind == TUNE), minlength=len(keys)).astype(np.int64)
        word = np.zeros(len(keys), bool)
        word[inverse[(both & 1) == 1]] = True
        bucket = int(pdf["bucket"].iloc[0])
        out, at = [], 0
        for chunk, kd, size in zip(pdf["chunk"], pdf["kind"], sizes, strict=True):
            mine = inverse[at : at + size]
            at += size
            out.append((chunk, kd, bucket, _pack_counts(counted[mine]), _pack_counts(tuned[mine]), 0, 0, 0, 0))
        # Held-out words by how often counted text has them, for the weight of the unigram estimate.
        cells, which = np.unique(_step_of_count(counted[word]), return_inverse=True)
        for cell, n in zip(cells.tolist(), np.bincount(which, weights=tuned[word], minlength=len(cells)).tolist(), strict=True):
            if n:
                out.append((-2, -2, bucket, b"", b"", cell, int(n), 0, 0))
        total = counted + tuned
        out.append((
            -1, -1, bucket, b"", b"", int((counted[word] > 0).sum()), int(counted[word].sum()),
            int((total[word] > 0).sum()), int(total[word].sum()),
        ))
        return pd.DataFrame(out, columns=given.names)

    return rows.mapInArrow(send, _ASK).groupBy("bucket").applyInPandas(add, _GIVEN)


_HELD = "chunk long, kind int, bucket int, counted binary, tuned binary, documents binary"


def _with_documents(rows: DataFrame, totals: DataFrame, kinds: list[int]) -> DataFrame:
    """Rows of totals and of packed documents, to be grouped by chunk."""
    held = _schema(_HELD)

    def documents(batches):
        import pickle

        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for c in chunks_of(batches, tuple(kinds)):
            # Codes are given in order of appearance, so frequent words have small ones: low bytes apart compress well.
            width = 3 if len(c.vocab) < 1 << 24 else 4
            planes = c.codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
            raw = pickle.dumps((c.ids, c.sizes, c.vocab, width, planes), protocol=5)
            yield _rows([(c.number, c.kind, -1, None, None, pack.compress(raw))], held)

    packed = rows.mapInArrow(documents, _HELD)
    given = totals.where(F.col("kind").isin(kinds)).select("chunk", "kind", "bucket", "counted", "tuned", F.lit(None).cast("binary").alias("documents"))
    return packed.unionByName(given)


def _opened(pdf) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk of a group and the totals of its n-grams."""
    import pickle

    import zstandard

    at = pdf["bucket"].to_numpy()
    row = pdf[at < 0].iloc[0]
    # Written by this job's own tasks.
    ids, sizes, vocab, width, planes = pickle.loads(zstandard.ZstdDecompressor().decompress(row["documents"]))
    wide = np.zeros((int(sizes.sum()), 4), np.uint8)
    wide[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    chunk = Chunk(int(row["chunk"]), int(row["kind"]), ids, sizes, wide.view("<u4").ravel().astype(np.int64), vocab)
    given = pdf[at >= 0].sort_values("bucket")
    return chunk, np.concatenate([_unpack_counts(x) for x in given["counted"]]), np.concatenate([_unpack_counts(x) for x in given["tuned"]])


@dataclass
class Weights:
    """m, l by bucket of the context count, and V and N of all training text."""

    unigram: float
    bigram: np.ndarray
    words: int
    tokens: int


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(n)), at most CONTEXT_BUCKETS - 1."""
    return np.minimum(np.frexp(n.astype(float))[1], CONTEXT_BUCKETS - 1)


def _em(cells: list[tuple[float, float]], rounds: int = 60) -> float:
    """The weight of an estimate against another, from (ratio of the first to the second, held-out tokens)."""
    if not cells:
        return 0.5
    r, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=float)
    w = 0.5
    for _ in range(rounds):
        share = w * r / (w * r + 1 - w)
        w = float(np.clip((n * share).sum() / n.sum(), 1e-6, 1 - 1e-6))
    return w


def _steps(ratio: np.ndarray) -> np.ndarray:
    """The logarithm of a ratio in steps; a ratio of 0 has a step of its own."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.round(np.log(ratio) * STEPS), -(1 << 30)).astype(np.int64)


def _ratio(step: int) -> float:
    return 0.0 if step == -(1 << 30) else math.exp(step / STEPS)


def _step_of_count(n: np.ndarray) -> np.ndarray:
    """A count, exact below 1024 and in steps of its logarithm above, so that cells are few whatever the input."""
    with np.errstate(divide="ignore"):
        return np.where(n < 1024, n, 1024 + np.round((np.log(np.maximum(n, 1)) - math.log(1024)) * STEPS)).astype(np.int64)


def _count_of_step(step: int) -> float:
    return step if step < 1024 else 1024 * math.exp((step - 1024) / STEPS)


def learn(rows: DataFrame, totals: DataFrame) -> Weights:
    """Expectation-maximisation on the held-out tokens, with the counts of the other training documents."""
    s = totals.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_words_all", "n_tokens_all")]).first()
    v, n = s["n_words"], s["n_tokens"]
    words = totals.where("chunk = -2").groupBy("n_words").agg(F.sum("n_tokens").alias("n")).collect()
    unigram = _em([(_count_of_step(r["n_words"]) * (v + 1.0) / max(1, n), r["n"]) for r in words])

    def cells(pdf):
        import pandas as pd

        chunk, counted, _ = _opened(pdf)
        _, _, wi, ci, pi = chunk.grams()
        p1 = unigram * counted[wi] / max(1, n) + (1 - unigram) / (v + 1.0)
        seen = counted[ci]
        cell = context_bucket(seen).astype(np.int64) << 40 | (_steps(counted[pi] / np.maximum(1, seen) / p1) + (1 << 31))
        cell, k = np.unique(cell, return_counts=True)
        return pd.DataFrame({"context": cell >> 40, "step": (cell & ((1 << 40) - 1)) - (1 << 31), "n": k})

    grouped = _with_documents(rows, totals, [TUNE]).groupBy("chunk").applyInPandas(cells, "context long, step long, n long")
    by: dict[int, list] = {}
    for r in grouped.groupBy("context", "step").agg(F.sum("n").alias("n")).collect():
        by.setdefault(r["context"], []).append((_ratio(r["step"]), r["n"]))
    bigram = np.zeros(CONTEXT_BUCKETS)
    for k in range(1, CONTEXT_BUCKETS):
        # A bucket without held-out tokens takes the weight of the bucket below.
        bigram[k] = _em(by[k]) if k in by else bigram[k - 1]
    return Weights(unigram, bigram, s["n_words_all"], s["n_tokens_all"])


def score_rows(spark: SparkSession, docs: DataFrame, folds: int = 7, test_fold: int = 2, tune_fold: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    from burrstone.session import cut

    at = common.fold("doc_id", folds)
    kind = F.when(at == test_fold, TEST).when(at == tune_fold, TUNE).otherwise(TRAIN)
    # Texts are read three times and never shuffled raw; reading them again must give the same rows in the same
    # partitions, as files and checkpointed tables do.
    rows = docs.select("doc_id", kind.alias("kind"), "text")
    buckets = BUCKETS * max(2, rows.rdd.getNumPartitions())
    totals = cut(gram_totals(rows, buckets))
    w = learn(rows, totals)

    def score(pdf):
        import pandas as pd

        chunk, counted, tuned = _opened(pdf)
        total = counted + tuned
        _, _, wi, ci, pi = chunk.grams()
        sizes = chunk.sizes
        cw, cu = total[wi], total[ci]
        base = np.log10((cw + 1.0) / (w.tokens + w.words + 1.0))
        p1 = w.unigram * cw / max(1, w.tokens) + (1 - w.unigram) / (w.words + 1.0) if w.tokens else np.ones(len(cw))
        mix = w.bigram[context_bucket(cu)]
        p = mix * total[pi] / np.maximum(1, cu) + (1 - mix) * p1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return pd.DataFrame({
            "doc_id": pd.array(chunk.ids, dtype="Int64"), "held_out": [chunk.kind == TEST] * len(sizes), "n_tokens": sizes,
            "n_known": np.add.reduceat(cw > 0, starts, dtype=np.int64), "train_tokens": [w.tokens] * len(sizes),
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_documents(rows, totals, [TRAIN, TUNE, TEST]).groupBy("chunk").applyInPandas(score, schema)
