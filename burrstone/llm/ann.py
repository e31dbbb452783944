"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are lifted onto a sphere of one more dimension, so that the largest inner product is the smallest angle. Each of
TABLES tables hashes a lifted vector by floor((a . x + b) / W) for several Gaussian-stable directions a; directions
of a table, and of as many tables as fit, are rows of one random rotation, so they tell different things. W and b are
set so that the two cells beside the median of each direction hold nearly all vectors. A query does not look into its
own bucket alone: given where neighbours lie (a model fitted on the nearest vectors of a sample, which tells their
length too), the chance that one falls into a bucket is the product over directions of the normal mass of the cell
around the query's projection. Buckets are perturbed from the likeliest one, only as far as needed, and visited in
falling order of that chance until their chances sum to the table's share of a target. The target is the least one of
TARGETS at which queries from the sample find RECALL of their neighbours there. Candidates of all tables are merged,
and their scores are exact inner products of the original vectors in double precision.

Buckets grow in number with the vectors, as long as a query of the sample visits at most PROBES of a table: where
neighbours stand out there are as many as one to IN_BUCKET vectors, where they do not (random vectors) each holds more.

Layout: the buckets of a table are cut into regions, regions with many vectors into blocks of at most VECTORS by a hash
of the id, the queries of a region into blocks of at most QUERIES. One group is one block of vectors with one block of
queries, so a bucket that holds a third of all vectors is many groups. Each group gives at most k rows a query.

Queries that found fewer than k candidates (few vectors, or a lonely query) are compared with all vectors, in the same
blocks. Only the sample (SAMPLE vectors) and counts go to the driver.

Cases: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components
take no part, nor do null ids; a repeated id is one item with the best score of its rows; ties go to the smaller id;
with fewer than k other vectors all of them are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TABLES = 8
#: Chances of a neighbour to be visited that are tried in turn, and the share of neighbours to be found in the sample.
TARGETS, RECALL = (0.92, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 0.9999), 0.95
#: Vectors of the sample that shows where neighbours lie, and the factor by which they are taken to lie farther.
SAMPLE, SAFE = 4096, 0.95
#: Vectors of the sample whose mean place stands for that of a query's neighbours, those whose mean length does, and
#: queries that calibrate the target.
NEAR, NEAREST, TRIED = 128, 8, 128
#: Vectors in a bucket, about; fewest and most directions of a table where vectors allow; visits to a table, about.
IN_BUCKET, FEW_BITS, MOST_BITS, PROBES = 6, 8, 30, 512
#: Vectors and queries of a group.
VECTORS, QUERIES = 32_768, 4_096
#: Width of a cell in standard deviations of a projection.
CELL = 4.0


@dataclass
class Index:
    """Directions, offsets and cell width of every table, and the sample that tells how far a query's neighbours lie."""

    dims: int  # of the vectors; directions have one more
    largest: float  # norm of any vector
    bits: int
    directions: np.ndarray  # (tables, dims, bits)
    offsets: np.ndarray  # (tables, bits)
    width: np.ndarray  # (tables, bits)
    sample: np.ndarray  # lifted
    sample_ids: np.ndarray
    rank: int  # of the neighbour in the sample that stands for the k-th among all
    region_bits: int
    target: float = TARGETS[0]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors on the unit sphere of one more dimension, where nearest by angle is largest by inner product."""
        y = x / self.largest
        return np.append(y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(1)))[:, None], axis=1)

    @staticmethod
    def lifted_query(q: np.ndarray) -> np.ndarray:
        return np.append(q / np.linalg.norm(q), 0.0)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """0 or 1 for each direction: rare outer cells are joined to the nearer of the two about the median."""
        h = np.floor((x @ self.directions[table] + self.offsets[table]) / self.width[table])
        return np.clip(h, -1, 0).astype(np.int64) + 1

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        return self.cells(self.lifted(x), table) @ (1 << np.arange(self.bits, dtype=np.int64)[::-1])

    def neighbour(self, q: np.ndarray, own_id: int) -> tuple[np.ndarray, float]:
        """Where a k-th neighbour of a query lies, and how far it strays from there. Along the query it has the
        similarity, a little less to be safe, of the same rank in the sample, or of the nearest there if the sample is
        too thin. Beside the query it lies like the mean of the nearest, with the rest of its length spread evenly."""
        of = self.lifted_query(q)
        s = self.sample @ of
        s[self.sample_ids == own_id] = -np.inf
        n = int(np.isfinite(s).sum())
        if not n:
            return 0.05 * of, 1.0
        near = np.argsort(-s, kind="stable")[: min(n, max(NEAR, self.rank))]
        rank = min(self.rank, n)
        rho = s[near[rank - 1]]
        rho = float(np.clip(rho - (1 - SAFE) * abs(rho), -0.999, 0.999))
        mean = self.sample[near].mean(0)
        mean[-1] = self.sample[near[: max(rank, NEAREST)], -1].mean()  # their length
        aside = mean - (mean @ of) * of
        return rho * of + aside, math.sqrt(max(1e-6, 1 - rho * rho - aside @ aside))

    def probes(self, at: np.ndarray, spread: float, table: int, target: float | None = None) -> np.ndarray:
        """Codes in falling order of the chance that a neighbour is there, up to the table's share of the target."""
        z = (at @ self.directions[table] + self.offsets[table]) / (spread * math.sqrt(2))
        up = np.array([0.5 * math.erfc(-v) for v in z])
        return likeliest(up, 1 - (1 - (target or self.target)) ** (1 / len(self.directions)))


def likeliest(up: np.ndarray, share: float) -> np.ndarray:
    """Codes of bits, each 1 with its chance and independent of the others, in falling order of chance (ties by the order
    of perturbation) until they sum to the share. A code is the likeliest one with some bits flipped; each flip costs the
    logarithm of its odds, and only codes that cost at most a limit are made, which grows until they suffice."""
    bits = len(up)
    place = np.int64(1) << np.arange(bits, dtype=np.int64)[::-1]
    low, high = np.maximum(np.minimum(up, 1 - up), 1e-300), np.maximum(up, 1 - up)
    best, cost = float(np.prod(high)), np.log(high / low)
    order = np.argsort(cost, kind="stable")
    limit = 2.0
    while True:
        sums, codes = np.zeros(1), np.array([int(place[up > 0.5].sum())], np.int64)
        for i in order:
            if cost[i] > limit:
                break
            more = sums + cost[i]
            kept = more <= limit
            sums, codes = np.append(sums, more[kept]), np.append(codes, codes[kept] ^ place[i])
        if best * np.exp(-sums).sum() >= share or len(sums) == 1 << bits or limit > 1400 * bits:
            break
        limit *= 1.4
    ranked = np.argsort(sums, kind="stable")
    return codes[ranked][: int(np.searchsorted(np.cumsum(best * np.exp(-sums[ranked])), share)) + 1]


def fit(vectors: DataFrame, k: int) -> Index | None:
    """An index fitted on a sample of SAMPLE vectors by a hash of the id, and the number of vectors."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    drawn = [np.array(r["v"], float) for r in rows]
    if not drawn:
        return None
    dims = Counter(len(v) for v in drawn).most_common(1)[0][0]
    s = np.stack([v for v in drawn if len(v) == dims])
    ids = np.array([r["vec_id"] for r, v in zip(rows, drawn, strict=True) if len(v) == dims])
    # One row of each id: a repeated id is one neighbour. The rank below is a share of all rows, so of all ids too.
    drawn_rows, once = len(s), np.sort(np.unique(ids, return_index=True)[1])
    s, ids = s[once], ids[once]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    n, largest = vectors.where(F.size("v") == dims).agg(F.count(F.lit(1)), F.max(norm)).first()
    base = Index(dims, largest, 0, np.zeros((0, dims + 1, 0)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, dims + 1)), ids, max(1, round(k * drawn_rows / max(1, n))), 0)
    base.sample = base.lifted(s)
    most = max(1, min(MOST_BITS, dims + 1, round(math.log2(max(2, n / IN_BUCKET)))))
    index = None
    for bits in sorted({min(most, b) for b in range(FEW_BITS, MOST_BITS + 1)}):
        finer, visits = _calibrated(_with_bits(base, bits, n))
        if index is not None and visits > PROBES:
            break
        index = finer
    return index


def _with_bits(base: Index, bits: int, n: int) -> Index:
    rng = np.random.default_rng(7)
    side = base.dims + 1
    directions: list[np.ndarray] = []
    while len(directions) < TABLES:
        rotation = np.linalg.qr(rng.standard_normal((side, side)))[0] * math.sqrt(side)
        directions += [rotation[:, i : i + bits] for i in range(0, side + 1 - bits, bits)]
    a = np.stack(directions[:TABLES])
    projected = np.einsum("nd,tdb->tnb", base.sample, a, optimize=True)
    region_bits = min(bits, max(0, math.ceil(math.log2(max(1, n / VECTORS)))))
    return replace(
        base, bits=bits, directions=a, offsets=-np.median(projected, axis=1), width=CELL * np.maximum(projected.std(1), 1e-9), region_bits=region_bits
    )


def _calibrated(index: Index) -> tuple[Index, float]:
    """The index with the least target at which queries of the sample find RECALL of their neighbours in it, and the
    visits to a table that this takes. The sample's ids are in order of a hash, so its first rows are drawn at random."""
    tried = np.random.default_rng(11).permutation(len(index.sample))[:TRIED]
    place = 1 << np.arange(index.bits, dtype=np.int64)[::-1]
    codes = [index.cells(index.sample, t) @ place for t in range(len(index.directions))]
    queries = []
    for i in tried:
        q = index.sample[i, :-1]
        scores = index.sample[:, :-1] @ q
        scores[i] = -np.inf
        if len(scores) > 1:
            rank = min(index.rank, len(scores) - 1)
            queries.append((*index.neighbour(q, index.sample_ids[i]), np.argpartition(-scores, rank - 1)[:rank]))
    visits = 0.0
    for target in TARGETS:
        found, seen = [], 0
        for at, spread, near in queries:
            hit = np.zeros(len(near), bool)
            for t, code in enumerate(codes):
                visited = index.probes(at, spread, t, target)
                seen += len(visited)
                hit |= np.isin(code[near], visited)
            found.append(hit.mean())
        visits = seen / max(1, len(queries) * len(codes))
        if not found or np.mean(found) >= RECALL:
            break
    return replace(index, target=target), visits


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )


def _search(pdf_q, pdf_v, k: int):
    """The best k of a block of vectors for each query of a block, over the buckets that the query visits."""
    import pandas as pd

    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if not len(pdf_q) or not len(pdf_v):
        return empty
    vs, qs = np.stack(pdf_v["v"].to_numpy()), np.stack(pdf_q["of"].to_numpy())
    vid, qid = pdf_v["vec_id"].to_numpy(), pdf_q["query"].to_numpy()
    code = pdf_v["code"].to_numpy()
    order = np.argsort(code, kind="stable")
    vs, vid, code = vs[order], vid[order], code[order]
    buckets, starts = np.unique(code, return_index=True)
    ends = np.append(starts[1:], len(code))
    names, name = np.unique(vid, return_inverse=True)
    out: list[tuple] = []
    for i in range(len(qs)):
        probes = pdf_q["codes"].iloc[i]
        if probes is None:
            rows = np.arange(len(vid))
        else:
            hit = np.searchsorted(buckets, np.sort(probes))
            hit = hit[hit < len(buckets)]
            hit = np.unique(hit[np.isin(buckets[hit], probes)])
            mark = np.zeros(len(code) + 1, np.int64)
            np.add.at(mark, starts[hit], 1)
            np.add.at(mark, ends[hit], -1)
            rows = np.flatnonzero(np.cumsum(mark[:-1]))
        if not len(rows):
            continue
        near = vs[rows] @ qs[i]
        near[vid[rows] == qid[i]] = -np.inf
        top = near
        if len(names) < len(vid):  # ids are ranked, each by the best of its rows
            top = np.full(len(names), -np.inf)
            np.maximum.at(top, name[rows], near)
        if len(top) > k:
            bar = np.partition(top, len(top) - k)[len(top) - k]
            rows = rows[near >= bar - 1e-9 * max(1.0, abs(bar))] if np.isfinite(bar) else rows
        rows = rows[vid[rows] != qid[i]]
        # Summed in one order for all, so that equal vectors have equal scores.
        score = (vs[rows] * qs[i]).sum(1)
        best = np.lexsort((vid[rows], -score))
        best = best[np.sort(np.unique(vid[rows][best], return_index=True)[1])[:k]]
        out.extend((qid[i], v, s) for v, s in zip(vid[rows][best].tolist(), score[best].tolist(), strict=True))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty


def _grouped(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Cut (t, region, ...) rows of both sides into blocks and search each pair of blocks."""
    place = ["t", "region"]
    nv = vectors.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / VECTORS).cast("int").alias("vblocks"))
    nq = queries.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qblocks"))
    sizes = nv.join(nq, place)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    v = vectors.join(sizes, place).select(
        *place, F.pmod(F.xxhash64("vec_id"), F.col("vblocks")).cast("int").alias("vb"), upto("qblocks").alias("qb"), "vec_id", "code", "v"
    )
    q = queries.join(sizes, place).select(
        *place, F.pmod(F.xxhash64("query"), F.col("qblocks")).cast("int").alias("qb"), upto("vblocks").alias("vb"), "query", "codes", "of"
    )
    keys = [*place, "vb", "qb"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(
        lambda a, b: _search(a, b, k), "query_id long, vec_id long, score double"
    )


def nearest(spark: SparkSession, df: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (a condition on vec_id) holds."""
    from burrstone.session import cut

    schema = "query_id long, rank int, vec_id long, score double"
    vectors = usable(df)
    index = fit(vectors, k)
    if index is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("v") == index.dims)
    sent = spark.sparkContext.broadcast(index)

    def hashed(batches: Iterator[dict]) -> Iterator[dict]:
        ix = sent.value
        for b in batches:
            x = np.array(b["v"], float).reshape(len(b["v"]), ix.dims)
            for t in range(len(ix.directions)):
                code = ix.codes(x, t)
                yield {"t": [t] * len(x), "region": code >> (ix.bits - ix.region_bits), "vec_id": b["vec_id"], "code": code, "v": b["v"]}

    def probed(batches: Iterator[dict]) -> Iterator[dict]:
        ix = sent.value
        for b in batches:
            out: dict = {c: [] for c in ("t", "region", "query", "codes", "of")}
            for i, v in zip(b["query"], b["of"], strict=True):
                q = np.array(v, float)
                at, spread = ix.neighbour(q, i)
                for t in range(len(ix.directions)):
                    codes = ix.probes(at, spread, t)
                    region = codes >> (ix.bits - ix.region_bits)
                    for r in np.unique(region):
                        for c, x in zip(out, (t, int(r), i, codes[region == r], v), strict=True):
                            out[c].append(x)
            yield out

    # Names of their own, as both sides come from one table.
    asked = vectors.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query"), F.col("v").alias("of"))
    v = common.arrow_map(vectors, hashed, "t int, region int, vec_id long, code int, v array<double>")
    q = common.arrow_map(asked, probed, "t int, region int, query long, codes array<int>, of array<double>")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = cut(best(_grouped(q, v, k)))
    enough = first.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = cut(asked.join(enough, asked["query"] == enough["query_id"], "left_anti"))
    if not short.count():
        return first
    # The exact way for queries that found too few: every block of vectors.
    every = vectors.select(F.lit(-1).alias("t"), F.lit(0).alias("region"), "vec_id", F.lit(0).alias("code"), "v")
    lonely = short.select(F.lit(-1).alias("t"), F.lit(0).alias("region"), "query", F.lit(None).cast("array<int>").alias("codes"), "of")
    again = best(_grouped(lonely, every, k))
    return first.join(enough, "query_id", "left_semi").select(*again.columns).unionByName(again)
