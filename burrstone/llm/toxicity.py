"""Toxicity by compression distance.

Two zstandard dictionaries are trained from a bounded sample of labelled documents: one of toxic text and one of
ordinary text. A window is a word in a fixed frame that both dictionaries hold, so that the entropy coder's fixed
costs cancel; its distance is the length under the ordinary dictionary less the length under the toxic one. A window
counts as toxic from a calibrated distance on, and a logistic curve fitted to the training sample turns the number of
such windows into a score.

What the toxic dictionary holds is learned, not listed: over the distinct contexts (word with both neighbours, so that
copies of a document count once) of the sample, the character n-grams that are found in toxic text far more often than
its share of all text, by a likelihood-ratio bar; the dictionary has the parts of toxic words that such n-grams cover.
Both dictionaries end with the same common words, so that ordinary prose costs the same under either.

Cases: null and empty texts have no windows and get the score of none; rows with a null id are scored and never learned
from; an id with several labels is toxic if any of them is; rows that repeat are scored each; with no toxic or no
ordinary sample every score is the share of toxic rows learned; long texts are scored whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The bound of the labelled sample: documents of either class, taken by a hash of their ids.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 1000, 3500
#: Characters of the n-grams that are tested, and the log-likelihood ratio (nats) that one needs.
GRAMS, BAR = (5, 6, 7, 8), 14.0
#: Bytes of a dictionary's own part, and words of the part that both have.
OWN_BYTES, COMMON_WORDS = 16384, 1500
#: Words of which a task remembers whether they are toxic; a full memory is emptied.
REMEMBERED = 100_000
#: The frame before and after a word. Any text that no document is likely to hold would do.
BEFORE = b"~Q7#0kx~zW|9Jq-5Yv&X+82_bKd@"
#: The longest word looked at in one piece; longer ones are cut into windows of this many characters.
WINDOW = 60

WORD = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    """Lower-cased runs of letters; a run longer than WINDOW is cut."""
    out = []
    for w in WORD.findall(text.lower()):
        if len(w) <= WINDOW:
            out.append(w)
        else:
            out.extend(w[i : i + WINDOW] for i in range(0, len(w), WINDOW))
    return out


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    bar: int
    weights: tuple[float, float, float]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=14, chain_log=14, search_log=6, min_match=4, target_length=32,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.toxic, self.ordinary)]
        return tuple(zstandard.ZstdCompressor(dict_data=d, compression_params=params) for d in raw)

    def distances(self):
        """A function from a word to its distance."""
        toxic, ordinary = self.compressors()
        return lambda w: len(ordinary.compress(b := b"%b %b %b" % (BEFORE, w.encode("utf-8", "replace"), BEFORE))) - len(toxic.compress(b))

    def score(self, hits: int, n: int) -> float:
        a, b, c = self.weights
        z = a + b * (hits > 0) + c * math.log1p(hits)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _distinct_contexts(docs: list[np.ndarray], n: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each of n words is found in contexts not seen before, and all contexts seen."""
    docs = [d for d in docs if len(d)]
    if not docs:
        return np.zeros(n, np.int64), seen
    # Documents end to end with a word of no number between them.
    gap = np.full(1, -1, np.int32)
    x = np.concatenate([p for d in docs for p in (gap, d)] + [gap]).astype(np.uint64) + np.uint64(2)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    middle = (x[1:-1] - np.uint64(2)).astype(np.int32)
    del x
    h, middle = h[middle >= 0], middle[middle >= 0]
    h, at = np.unique(h, return_index=True)
    new = ~np.isin(h, seen)
    return np.bincount(middle[at[new]], minlength=n), np.union1d(seen, h)


def _ratio(a: int, b: int, share: float) -> float:
    """The log-likelihood ratio of a toxic and b ordinary finds against the toxic share of all; 0 if they are not more."""
    e = (a + b) * share
    return 0.0 if a <= e else a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0.0)


def _telling(names: list[str], toxic: np.ndarray, ordinary: np.ndarray, share: float) -> set[str]:
    """Character n-grams that tell toxic text, one length at a time."""
    out: set[str] = set()
    for m in GRAMS:
        def grams(w: str, m: int = m) -> set[str]:
            w = f" {w} "
            return {w[i : i + m] for i in range(len(w) - m + 1)}

        found: Counter = Counter()
        for k in np.flatnonzero(toxic).tolist():
            n = int(toxic[k])
            for g in grams(names[k]):
                found[g] += n
        found = Counter({g: n for g, n in found.items() if _ratio(n, 0, share) > BAR})
        beside: Counter = Counter()
        for k in np.flatnonzero(ordinary).tolist():
            n = int(ordinary[k])
            for g in grams(names[k]):
                if g in found:
                    beside[g] += n
        out |= {g for g, a in found.items() if _ratio(a, beside[g], share) > BAR and a > 1.5 * beside[g]}
    return out


def train(toxic_texts: list[str], ordinary_texts: list[str]) -> Model:
    """Both dictionaries, the bar of a window and the curve of the score from sampled texts."""
    rate = (len(toxic_texts) + 0.5) / (len(toxic_texts) + len(ordinary_texts) + 1)
    base = Model(b"", b"", 1, (math.log(rate / (1 - rate)) if toxic_texts else -30.0, 0.0, 0.0))
    if not toxic_texts or not ordinary_texts:
        return base
    ids: dict[str, int] = {}
    numbers = [[np.array([ids.setdefault(w, len(ids)) for w in windows(t)], dtype=np.int32) for t in ts] for ts in (ordinary_texts, toxic_texts)]
    names = list(ids)
    del ids
    ordinary, seen = _distinct_contexts(numbers[0], len(names), np.zeros(0, np.uint64))
    toxic, _ = _distinct_contexts(numbers[1], len(names), seen)
    del seen
    share = toxic.sum() / max(1, toxic.sum() + ordinary.sum())
    telling = _telling(names, toxic, ordinary, share)
    pieces: Counter = Counter()
    for k in np.flatnonzero(toxic).tolist():
        w = f" {names[k]} "
        covered = [False] * len(w)
        for m in GRAMS:
            for i in range(len(w) - m + 1):
                if w[i : i + m] in telling:
                    covered[i : i + m] = [True] * m
        for piece in "".join(c if on else "\0" for c, on in zip(w, covered, strict=True)).split("\0"):
            if len(piece) >= min(GRAMS):
                pieces[piece] += int(toxic[k])
    ranked = [names[k] for k in np.argsort(-ordinary, kind="stable")[: COMMON_WORDS + OWN_BYTES] if ordinary[k]]
    own = "".join(p for p, _ in sorted(pieces.items(), key=lambda x: (x[1], x[0]))).encode()[-OWN_BYTES:]
    common_part = (" " + " ".join(reversed(ranked[:COMMON_WORDS])) + " ").encode() + BEFORE
    rest = (" " + " ".join(ranked[COMMON_WORDS:])).encode()
    model = Model(own + common_part, rest[: len(own)] + common_part, 1, base.weights)
    # The bar of a window: the distance from which on the likelihood ratio of toxic windows is largest.
    distance = model.distances()
    far = np.fromiter((distance(w) for w in names), np.int32, len(names))
    best = (-1.0, 2)
    for bar in range(1, 9):
        a, b = int(toxic[far >= bar].sum()), int(ordinary[far >= bar].sum())
        best = max(best, (_ratio(a, b, share) if a + b else 0.0, bar))
    model.bar = best[1]
    hot = far >= model.bar
    hits = np.array([float(hot[d].sum()) for side in numbers for d in side])
    y = np.array([0.0] * len(numbers[0]) + [1.0] * len(numbers[1]))
    x = np.stack([np.ones_like(hits), hits > 0, np.log1p(hits)], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-6, 0.1, 0.1])
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    model.weights = tuple(float(v) for v in w)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> Model:
    """Learn from a sample of at most TOXIC_SAMPLE + ORDINARY_SAMPLE labelled rows outside the held-out fold.

    The sample is drawn from the labels by a hash of the id; only its ids are broadcast to the scan of the texts.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (common.fold("doc_id", folds) != held_out_fold))
        .groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("toxic").alias("is_toxic"))
    )
    drawn = [
        marked.where((F.col("is_toxic") > 0) == yes).orderBy(F.xxhash64("sample_id"), "sample_id").limit(n)
        for yes, n in ((True, TOXIC_SAMPLE), (False, ORDINARY_SAMPLE))
    ]
    sample = drawn[0].unionByName(drawn[1])
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id"))
        .select("doc_id", "is_toxic", F.coalesce("text", F.lit("")).alias("text")).collect()
    )
    texts.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in texts if r["is_toxic"] > 0], [r["text"] for r in texts if r["is_toxic"] <= 0])


def score_rows(docs: DataFrame, model: Model, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of windows and toxic windows of each document."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        distance, known = model.distances(), {}
        for b in batches:
            out: dict = {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": [], "predicted": [], "n_windows": [], "n_toxic": []}
            for text in b["text"]:
                ws = windows(text or "")
                hits = 0
                for w in ws:
                    hot = known.get(w)
                    if hot is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = hot = distance(w) >= model.bar
                    hits += hot
                s = model.score(hits, len(ws))
                out["score"].append(s)
                out["predicted"].append(int(s >= 0.5))
                out["n_windows"].append(len(ws))
                out["n_toxic"].append(hits)
            yield out

    held = F.col("doc_id").isNotNull() & (common.fold("doc_id", folds) == held_out_fold)
    return common.arrow_map(
        docs.select("doc_id", held.alias("held_out"), "text"), rows,
        "doc_id long, held_out boolean, score double, predicted int, n_windows long, n_toxic long",
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text the model does not reject. Rows stay in place: nothing is shuffled."""

    def verdict(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        distance, known = model.distances(), {}
        for b in batches:
            keep = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                hits, ws = 0, windows(text or "")
                for w in ws:
                    hot = known.get(w)
                    if hot is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = hot = distance(w) >= model.bar
                    hits += hot
                keep.append(model.score(hits, len(ws)) < 0.5)
            yield b.filter(pc.cast(pa.array(keep, type=pa.bool_()), pa.bool_()))

    return docs.mapInArrow(verdict, docs.schema)
