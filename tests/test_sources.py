"""Readers, writers and generators."""

import pytest
from pyspark.sql import functions as F

from burrstone.sources import files, generators


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_edges_round_trip(spark, tmp_path, fmt):
    e = spark.createDataFrame([(0, 1), (5, 2), (5, 5)], "src long, dst long")
    files.save_edges(e, str(tmp_path / "e"), fmt)
    assert tuples(files.load_edges(spark, str(tmp_path / "e"), fmt)) == [(0, 1), (5, 2), (5, 5)]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unknown edge format"):
        files.load_edges(spark, "x", "nope")


def test_packed_size_is_checked(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"\0" * 20)
    with pytest.raises(ValueError, match="no multiple"):
        files.read_packed(spark, str(tmp_path / "f.bin"), ["a", "b"])


def test_packed_extremes(spark, tmp_path):
    rows = [(-(1 << 63), (1 << 63) - 1), (0, -1)]
    files.write_packed(spark.createDataFrame(rows, "a long, b long"), str(tmp_path / "p"))
    assert tuples(files.read_packed(spark, str(tmp_path / "p"), ["a", "b"])) == rows


def test_row_count_and_comments(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("# c\n1\t2\n3\t4\n")
    assert tuples(files.read_tsv(spark, str(tmp_path / "e.tsv"), ["a", "b"], 2)) == [(1, 2), (3, 4)]
    with pytest.raises(ValueError, match="not 3"):
        files.read_tsv(spark, str(tmp_path / "e.tsv"), ["a", "b"], 3)


def test_words_of_any_arity(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" 1  2\t3 \n\n# x\n4 5 6\n")
    assert tuples(files.read_words(spark, str(tmp_path / "w.txt"), [("a", "long"), ("b", "long"), ("c", "long")])) == [(1, 2, 3), (4, 5, 6)]


@pytest.mark.parametrize("field, symmetry, want", [
    ("real", "general", [(2, 1, 1.5), (3, 3, 2.0)]),
    ("real", "symmetric", [(1, 2, 1.5), (2, 1, 1.5), (3, 3, 2.0)]),
    ("real", "skew-symmetric", [(1, 2, -1.5), (2, 1, 1.5), (3, 3, 2.0)]),
    ("pattern", "general", [(2, 1, 1.0), (3, 3, 1.0)]),
])
def test_matrix_market(spark, tmp_path, field, symmetry, want):
    cells = ["2 1", "3 3"] if field == "pattern" else ["2 1 1.5", "3 3 2"]
    (tmp_path / "m.mtx").write_text(f"%%MatrixMarket matrix coordinate {field} {symmetry}\n% note\n3 3 2\n" + "\n".join(cells) + "\n")
    assert tuples(files.read_matrix(spark, str(tmp_path / "m.mtx"))) == want


def test_matrix_in_parts_joined_is_one_file(spark, tmp_path):
    entries = spark.range(1, 400, 1, 5).selectExpr("id as i", "400 - id as j", "id / 2.0 as v")
    files.write_matrix(entries, str(tmp_path / "m"))
    parts = sorted((tmp_path / "m").glob("part-*"))
    assert len(parts) > 1
    (tmp_path / "one.mtx").write_text("".join(p.read_text() for p in parts))
    for path in ("m", "one.mtx"):
        assert tuples(files.read_matrix(spark, str(tmp_path / path))) == [(i, 400 - i, i / 2) for i in range(1, 400)]
    files.write_matrix(entries.limit(0), str(tmp_path / "none"))
    assert tuples(files.read_matrix(spark, str(tmp_path / "none"))) == []


def test_text_to_packed_rejects_other_arity(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="arity"):
        files.text_to_packed(spark, str(tmp_path / "t.txt"), str(tmp_path / "o"), 2, ",")


def test_kronecker_repeats_and_permutes(spark):
    a = generators.kronecker(spark, 8, 500).collect()
    assert a == generators.kronecker(spark, 8, 500).collect()
    ids = spark.range(256).select(generators.scramble(F.col("id"), 8, 3).alias("v")).distinct()
    assert ids.count() == 256


def test_tree_kinds(spark):
    balanced = generators.unbalanced_tree(spark, 1, kind="balanced", b0=3, most_depth=3)
    assert [r["nodes"] for r in balanced.orderBy("depth").collect()] == [1, 3, 9, 27]
    for kind, shape in (("geometric", generators.LINEAR), ("geometric", generators.CYCLIC), ("binomial", 0), ("hybrid", generators.FIXED)):
        rows = generators.unbalanced_tree(spark, 42, kind=kind, b0=3.0, most_depth=2, shape=shape, q=0.1, m=3).collect()
        assert rows[0]["nodes"] == 1 and rows[-1]["nodes"] == rows[-1]["leaves"]
