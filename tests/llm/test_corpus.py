"""Near-duplicates, line dedup, decontamination, language model and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from burrstone.llm import common, decontamination, linededup, lm, neardup, queries
from tests import oracle

WORDS = [f"w{i}" for i in range(400)]


def words_of(t):
    return common.words(t)


def shingles(t, n):
    ws = words_of(t)
    return frozenset(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)) if len(ws) >= n else frozenset([tuple(ws)] if ws else [])


def brute_components(rows, n, percent=80):
    """Least id reachable, by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def edited(rng, text, rate):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in text.split())


def cells(monkeypatch, small):
    for name, size in (("MET", 5), ("CELL", 3), ("CELL_SHINGLES", 400), ("BLOCK", 4)):
        if small:
            monkeypatch.setattr(neardup, name, size)


@pytest.mark.parametrize("n, small", [(2, False), (5, False), (2, True)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, n, small):
    cells(monkeypatch, small)
    rng = random.Random(n)
    rows = []
    for _ in range(25):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.choice([4, 12, 60, 200])))
        rows += [base] + [edited(rng, base, rng.choice([0, 0.02, 0.05, 0.1])) for _ in range(rng.randint(0, 8))]
    # A large group with very different amounts of editing: some reach each other only past their pivot.
    base = " ".join(rng.choice(WORDS) for _ in range(150))
    rows += [edited(rng, base, rng.random() * 0.25) for _ in range(70)]
    rows += ["", None, "one", "ONE", "one two", "a b c d e", "a b c d e f", " \t", "x " * 3000, "x " * 2000]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows, strict=True))
    rows += [rows[0], (None, rows[0][1])]
    df = spark.createDataFrame([(i, t, 5, True, 1) for i, t in rows], "doc_id long, text string, n int, kept boolean, key int").repartition(3)
    got = neardup.near_duplicates(spark, df, n).collect()
    want = brute_components(rows, n)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    sizes = {i: len(shingles(t, n)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)
    kept = neardup.keep_one(spark, df, n)
    assert kept.columns == df.columns and kept.where("doc_id IS NOT NULL").select("doc_id").distinct().count() == len(set(want.values()))


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_strays_of_a_group_are_linked_by_any_pair(spark, monkeypatch, small):
    """Members that are not near their pivot, 1, but near each other: a spanning forest of the exact links comes back."""
    cells(monkeypatch, small)
    rng = random.Random(3)
    bases = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(4)]
    rows = [(1, bases[0])] + [(i, edited(rng, bases[i % 3 + 1], 0.02)) for i in range(2, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    facts = spark.createDataFrame([(i, len(shingles(t, 2)), *[0] * neardup.PLANES) for i, t in rows], "id long, " + ", ".join(f"{c} long" for c in neardup._FACTS))
    members = spark.createDataFrame([(1, i) for i, _ in rows], "pivot long, id long")
    comp = spark.createDataFrame([(5, 2), (2, 2)], "id long, component long")
    got = [tuple(r) for r in neardup._stray_links(members, facts, comp, docs, 2, 80).collect()]
    sets = {i: shingles(t, 2) for i, t in rows}
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in got)
    from burrstone.operators.components import components

    links = spark.createDataFrame([*got, (5, 2)], "pivot long, id long")
    made = {r["id"]: r["component"] for r in components(links, "pivot", "id").collect()}
    assert {i: made.get(i, i) for i, _ in rows} == brute_components(rows, 2)
    if not small:
        assert len(got) < len(rows)


def test_index_guarantee():
    """Signatures that differ in at most 2 * CHUNKS - 1 index symbols share a key."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 62, (1, neardup.SYMBOLS), dtype=np.uint64)
        b = a.copy()
        at = rng.choice(neardup.CHUNKS * neardup.WIDTH, 2 * neardup.CHUNKS - 1, replace=False)
        b[0, at] += np.uint64(1)
        assert set(neardup.index_keys(a)[0].tolist()) & set(neardup.index_keys(b)[0].tolist())


LINES = ["Shared line", "  shared LINE\t", "rare", "", "ünï", "tail"]


def line_rows(rng):
    rows = [(i, "\n".join(rng.choice(LINES + [f"own {i}"]) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "shared line\r"), (3, "again"), (None, "shared line\nx")]


def brute_lines(rows, least, chars):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(common.LOWER)
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, ls in docs for k in {key(x) for x in ls})
    hot = {k for k, c in n.items() if c >= least and len(k) >= chars}
    return sorted((repr(i), len(ls), sum(key(x) in hot for x in ls), hashlib.sha256("\n".join(x for x in ls if key(x) not in hot).encode()).hexdigest()) for i, ls in docs)


@pytest.mark.parametrize("least, chars, sent", [(10, 1, 1 << 26), (10, 1, 0), (2, 3, 1 << 26), (1, 0, 1 << 26), (1000, 1, 0)])
def test_lines_against_brute_force(spark, monkeypatch, least, chars, sent):
    monkeypatch.setattr(linededup, "SENT_BYTES", sent)
    rows = line_rows(random.Random(least))
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, hi string, n_lines int").repartition(3)
    got = sorted((repr(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.digest_rows(spark, df, least, chars).collect())
    assert got == brute_lines(rows, least, chars)
    assert linededup.clean_documents(spark, df, least, chars).columns == df.columns
    assert linededup.digest_rows(spark, df.where("doc_id = 12345")).count() == 0


def test_line_counts_are_reversible(spark):
    rows = line_rows(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, rest = df.where("doc_id < 20"), df.where("doc_id >= 20")
    table = lambda d: sorted(tuple(r) for r in d.collect())
    grown = linededup.updated_counts(linededup.reference_counts(first), rest, removed=False)
    assert table(grown) == table(linededup.reference_counts(first.union(rest)))
    assert table(linededup.updated_counts(grown, rest, removed=True)) == table(linededup.reference_counts(first))


def test_filters_follow_members(spark):
    members = spark.range(500).select((F.col("id") * 7919 - 900).alias("hi"), F.xxhash64("id").alias("lo"))
    built = linededup.build_filters(members, 4)
    gone, new = members.limit(100), spark.range(500, 560).select((F.col("id") * 7919 - 900).alias("hi"), F.xxhash64("id").alias("lo"))
    rows = {r["shard"]: r for r in linededup.updated_filters(built, new, gone, 4).collect()}
    assert sum(r["n"] for r in rows.values()) == 460
    left = {(r["hi"], r["lo"]) for r in gone.collect()}
    for r in members.union(new).collect():
        if (r["hi"], r["lo"]) not in left and rows[r["lo"] % 4]["filter"] is not None:
            assert linededup.CuckooFilter.from_bytes(bytes(rows[r["lo"] % 4]["filter"])).contains(np.array([r["hi"]], np.int64).view(np.uint64))[0]


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = linededup.CuckooFilter.build(hashes)
    assert f.contains(hashes).all()
    assert f.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.002
    assert all(f.delete(int(h)) for h in hashes[:2000]) and f.contains(hashes[2000:]).all()


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew potions under a pale moon tonight".split()


def test_contamination(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    changed = [w if k % 7 else "changed" for k, w in enumerate(ITEM)]
    short = ITEM[:5]
    rows = [
        (1, filler(100) + " " + " ".join(ITEM).upper() + ". " + filler(50)), (2, filler(80) + " " + " ".join(changed)), (3, filler(3000)),
        (4, filler(60) + " " + " ".join(short) + " " + filler(60)), (5, None), (6, ""), (None, " ".join(ITEM)), (1, filler(9)),
        (7, filler(20000) + " " + " ".join(ITEM[:6] + ["and"] + ITEM[6:12] + ITEM[13:]) + " " + filler(300)),
    ]
    docs = spark.createDataFrame([(i, t, "k", 0.5) for i, t in rows], "doc_id long, text string, item_id string, score double")
    items = spark.createDataFrame([(10, " ".join(ITEM)), (11, "zig zag"), (12, ""), (13, None), (None, "never seen words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(spark, docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 10), (7, 10)}
    assert got[1, 10]["score"] == 1.0 and got[1, 10]["start"] == 100 and got[1, 10]["stop"] == 100 + len(ITEM) and got[7, 10]["score"] > 0.8
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(spark, docs, items).collect()) == [1, 3, 4, 5, 6]
    assert decontamination.contaminated(spark, docs, items.where("item_id = 999")).count() == 0
    assert decontamination.contaminated(spark, docs.where("doc_id = 999"), items).count() == 0


def test_columns_of_the_caller_keep_their_names_and_values(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SENT_BYTES", 0)
    rows = [(i, "same line\nown %d" % i, "k%d" % i, i, [i], i, "x") for i in range(12)] + [(12, "a b c d e f g h", "k12", 1, None, 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, th int, gone array<int>, window int, __key string")
    kept = linededup.clean_documents(spark, docs, 10, 1)
    assert kept.columns == docs.columns
    assert sorted((r["row_key"], r["th"], r["gone"], r["text"]) for r in kept.collect()) == sorted((r[2], r[3], r[4], r[1].replace("same line\n", "")) for r in rows)
    clean = decontamination.clean_documents(spark, docs, spark.createDataFrame([(1, "A b c, d e f g h")], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(r["row_key"] for r in clean.collect()) == sorted(r[2] for r in rows[:-1])


def test_a_passage_in_most_documents_is_still_found(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + " " + " ".join(ITEM)) for i in range(60)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    assert decontamination.contaminated(spark, docs, items).count() == 60


def test_one_edited_passage_in_most_documents_is_still_found(spark):
    rng = random.Random(6)
    changed, half = " ".join(w if k % 7 else "changed" for k, w in enumerate(ITEM)), " ".join(ITEM[:10])
    for passage in (changed, half):
        rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + " " + passage) for i in range(60)]
        docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
        got = decontamination.contaminated(spark, docs, items).collect()
        assert len(got) == 60 and all(r["seeds"] for r in got)


def test_no_alignment_exceeds_its_bound():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 12))], np.uint64) for _ in range(2))
        assert decontamination.align(a, b)[0] <= decontamination.most(a, b)


def test_items_in_blocks_find_the_same(spark, sf_dir, monkeypatch):
    one = {tuple(r) for r in queries.op8_decontamination(spark, sf_dir).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(decontamination, "BLOCK_GRAMS", 700)
    assert one == {tuple(r) for r in queries.op8_decontamination(spark, sf_dir).select("doc_id", "item_id").collect()} and one


def test_alignment_is_smith_waterman():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert decontamination.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == max(map(max, h))


def lm_rows():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "B", "c", "d", "e f", "rare%d" % i]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (7, "a b\nc"), (None, "a b"), (502, "a " * 3000), (503, "ünknown")]


@pytest.mark.parametrize("chunk", [lm.CHUNK_TOKENS, 50])
def test_language_model_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    rows = lm_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kind int").repartition(3)
    learned = []
    plain = lm.learn
    monkeypatch.setattr(lm, "learn", lambda r, t: learned.append(plain(r, t)) or learned[-1])
    got = sorted(lm.score_rows(spark, df).collect(), key=lambda r: (repr(r["doc_id"]), r["n_tokens"]))
    w = learned[0]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    docs = [(i, words_of(t) + [b"\n"]) for i, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, ts in docs:
        if fold(i) != 2:
            uni.update(ts)
            bi.update(zip([None, *ts], ts))
            ctx.update([None, *ts[:-1]])
    n, v = sum(uni.values()), len(uni)
    assert (w.tokens, w.words) == (n, v) and 0 < w.unigram < 1 and ((w.bigram >= 0) & (w.bigram <= 1)).all()
    want = []
    for i, ts in docs:
        base = sum(math.log10((uni[t] + 1) / (n + v + 1)) for t in ts)
        score = 0.0
        for u, t in zip([None, *ts], ts):
            p1 = w.unigram * uni[t] / n + (1 - w.unigram) / (v + 1)
            mix = w.bigram[int(lm.context_bucket(np.array([ctx[u]]))[0])]
            score += math.log10(mix * bi[u, t] / max(1, ctx[u]) + (1 - mix) * p1)
        want.append((i, i is not None and fold(i) == 2, len(ts), sum(uni[t] > 0 for t in ts), base, score))
    want.sort(key=lambda r: (repr(r[0]), r[2]))
    for r, x in zip(got, want, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (*x[:4], n)
        assert r["base_score"] == pytest.approx(x[4]) and r["score"] == pytest.approx(x[5])


def test_language_model_beats_its_base_on_held_out_text(spark):
    rows = queries.op6_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_expectation_maximisation_finds_the_best_weight():
    cells = [(3.0, 40), (0.2, 25), (0.0, 10), (1.5, 5)]
    best = max((sum(n * math.log(w * r + 1 - w) for r, n in cells), w) for w in np.linspace(0.001, 0.999, 999))[1]
    assert lm._em(cells, 500) == pytest.approx(best, abs=0.01)


def test_packed_keys_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lm._unpack_keys(lm._pack_keys(keys)) == keys).all()


def test_line_query_against_sql(spark, sf_dir):
    oracle.assert_same(queries.op7_line_dedup(spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE["op7_line_dedup"])


def test_pipeline(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept["line_dedup"].keys() == kept["toxicity"].keys()
    rows = sorted(kept["line_dedup"].items())
    want = brute_components(rows, 5)
    assert set(kept["near_dedup"]) == {i for i, c in want.items() if i == c}
    assert not decontamination.contaminated(spark, docs, common.read(spark, sf_dir, "benchmark")).count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == set(kept["decontamination"])
    assert len(corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()) == len(kept["decontamination"])


def test_pipeline_of_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0), (None, "text with no id", "en", "s", 15), (4, "w " * 5000, "en", "s", 10000)], common.read(spark, sf_dir, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 4
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == 4
    empty = docs.where("doc_id = 99")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
