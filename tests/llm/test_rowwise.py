"""Sharding, packing, token counts and toxicity."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from burrstone.llm import packing, queries, sharding, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def jump(key, n):
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, size long, shard string, block int, law string")


def doc(i, text):
    return (i, text, 7, "x", 1, "y")


ODD = [doc(1, "a b"), doc(2, None), doc(3, ""), doc(4, "é漢😀"), doc(5, "a b"), doc(5, "a b"), doc(None, "n"), doc(-9, "x" * 5000), doc((1 << 63) - 1, "big")]


def test_sharding_is_jump_hash(spark):
    rows = sharding.shard_rows(docs_of(spark, ODD), 24).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"] or 0, 24), jump(r["doc_id"] or 0, 25))
        assert r["grown_shard"] in (r["shard"], 24)
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert sizes[2] == (8, 0) and sizes[4] == (8 + 9, zlib.crc32("é漢😀".encode()))
    assert sharding.shard_rows(docs_of(spark, []), 24).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 24])
def test_slots_have_no_gaps(spark, shards):
    df = spark.range(3000).select((F.col("id") * 977 - 500).alias("doc_id"), F.lit("t").alias("text"))
    by = {}
    for r in sharding.shard_rows(df, shards).collect():
        assert 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_runs_no_python(spark, sf_dir):
    plan = queries.op5_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


TEXTS = [
    "", " ", "Hello, WORLD! it's 1234", "a\x1cb", "İstanbul ΑΣ", "x<|endoftext|>y", "é é é́", "漢字 😀 👩‍👩‍👧", "a_b __ x² ½ ª º µ", "''s .'s don't", "word " * 9000,
    "ŉ ǅ\xa0ǆ\x85end",
]


def test_word_ids_are_the_tokenizers():
    enc = packing.WordIds(WORDS)
    for t in TEXTS + TEXTS[::-1]:
        assert enc.encode(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    enc = packing.WordIds(WORDS)
    got = [enc.encode(t).tolist() for t in TEXTS]
    assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("window", [8, 64, 4096])
def test_packing_round_trip(spark, window):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(99, None, 2), (3, "again", 3), (None, "no id", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    pieces = packing.pack(df, WORDS, window).collect()
    tok = packing.WordIds(WORDS).tokenizer
    want = sorted((repr(i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
    whole = {}
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"]
        whole.setdefault((repr(p["doc_id"]), p["doc_tokens"]), []).append(p)
    got = []
    for (i, n), ps in whole.items():
        ps.sort(key=lambda p: p["start"])
        assert sum(p["length"] for p in ps) == n and all(a["start"] + a["length"] == b["start"] for a, b in zip(ps, ps[1:]))
        got.append((i, tuple(np.frombuffer(b"".join(bytes(p["ids"]) for p in ps), "<u4").tolist())))
    assert sorted(got) == want
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in seqs.values():
        s.sort()
        total = 0
        for at, n in s:
            assert at == total
            total += n
        assert total == window or total < window and total & (total - 1) == 0
    assert packing.pack(df.where("doc_id = 12345"), WORDS).count() == 0


def test_packer_takes_the_level_of_least_squares():
    p = packing.Packer(10, 1)
    for k, size in enumerate([6, 6, 3]):
        assert p.add(((k, size), 0, size, b"\0" * 4 * size)) == []
    # Levels 6, 6 and 3 or 6 and 9: with two windows at 6, moving one to 9 makes the sum of squares least.
    assert p.counts.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0]
    assert [[x[0][0] for x in w] for w in p.add(((3, 1), 0, 1, b"\0" * 4))] == [[1, 2, 3]]
    rest = p.close()
    assert sum(x[2] for w in rest for x in w) == 6


def test_packer_tops_up_short_windows():
    """A window that lacks less than a level takes the first tokens of the next piece; few windows stay open."""
    rng = np.random.default_rng(5)
    p, tokens, full = packing.Packer(1000, 50), 0, []
    for k in range(4000):
        size = int(min(1000, rng.lognormal(5, 1) + 1))
        tokens += size
        full += p.add(((k, size), 0, size, b"\0" * 4 * size))
    assert all(sum(x[2] for x in w) == 1000 for w in full)
    assert sum(map(len, p.open)) < 40 and sum(f for level in p.open for f, _ in level) < 0.05 * tokens
    assert sum(x[2] for w in full + p.close() for x in w) == tokens


COUNTER = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edits_equal_a_recount():
    c = tokens.Counter(*COUNTER)
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "'", "re", "'ll", "\n", "1", "é", "漢", "!", "\t", "<|endoftext|>"]
    for k in range(400):
        tree = tokens.TokenTree("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 60, 900]))), c)
        for _ in range(5):
            a = rng.randint(-2, len(tree.text) + 2)
            tree.edit(a, a + rng.choice([0, 1, 5, 300]), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))))
            assert tree.total == len(c.encoding.encode_ordinary(tree.text))
            assert tree.leaves == len(c.split(tree.text)) and int(tree.chars[1]) == len(tree.text)


def test_edits_touch_little():
    c = tokens.Counter(*COUNTER)
    tree = tokens.TokenTree("some words in a row " * 5000, c)
    tree.edit(40_000, 40_005, "other")
    assert tree.encoded < 12


def test_count_edited_cases(spark):
    rows = [(1, "hello world", [(0, 5, "bye")]), (2, None, [(0, 3, "new text")]), (3, "", None), (4, "keep", []), (4, "keep", []), (None, "x", [(0, 9, None)]), (6, "abc", [(None, 1, "z")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,stop:long,replacement:string>>")
    got = {(r["doc_id"], r["n_edits"]): r for r in tokens.count_edited(df, *COUNTER).collect()}
    n = lambda t: len(tokens.Counter(*COUNTER).encoding.encode_ordinary(t))
    assert got[1, 1]["n_tokens"] == n("hello world") and got[1, 1]["n_tokens_after"] == n("bye world")
    assert got[2, 1]["n_tokens"] == 0 and got[2, 1]["n_tokens_after"] == n("new text")
    assert got[3, 0]["n_tokens_after"] == 0 and got[None, 1]["n_chars_after"] == 0 and got[6, 1]["n_tokens_after"] == n("zbc")
    assert tokens.count_edited(df.where("doc_id > 100"), *COUNTER).count() == 0


def test_edit_query_against_recount(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", tokens.revision_edits(F.col("text"), F.col("doc_id")).alias("e")).collect()}
    enc = tokens.Counter(*COUNTER).encoding
    rows = queries.op1_edit_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        assert r["n_tokens"] == len(enc.encode_ordinary(text))
        for e in docs[r["doc_id"]]["e"]:
            text = text[: e["start"]] + e["replacement"] + text[max(e["start"], e["stop"]) :]
        assert (r["n_tokens_after"], r["n_chars_after"]) == (len(enc.encode_ordinary(text)), len(text))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] for r in rows if r["toxic"])
    wrong = sum(r["predicted"] for r in rows if not r["toxic"])
    assert hit >= 0.7 * sum(r["toxic"] for r in rows) and wrong <= 0.05 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_cases(spark):
    rng = random.Random(1)
    some = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(n))
    bad, good = [f"{some(6)} stinker {some(6)}" for _ in range(60)], [some(13) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(bad + good)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "stinker"), (1002, "stinker " * 50), (1002, "stinker " * 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i in range(len(rows))] + [(None, 1), (5, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {(r["doc_id"], r["n_windows"]): r for r in toxicity.score_rows(docs, model).collect()}
    assert got[1002, 50]["predicted"] == 1 and got[1000, 0]["score"] == got[1001, 0]["score"] < 0.5
    assert toxicity.keep_clean(docs, model).where("text like '%stinker%'").count() == 0
    assert toxicity.keep_clean(docs, model).count() == len(good) + 2
    empty = toxicity.fit(docs, labels.where("doc_id > 99999"))
    assert all(r["predicted"] == 0 for r in toxicity.score_rows(docs, empty).collect())
    assert toxicity.score_rows(docs.where("doc_id > 99999"), model).count() == 0
