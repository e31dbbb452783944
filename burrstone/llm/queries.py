"""The llm queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, common, decontamination, html, linededup, lm, neardup, packing, sharding, tokens, toxicity

SHARDS = 24
MIN_LINE_DOCS, MIN_LINE_CHARS = 10, 1


def tokenizer_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    docs = common.read(spark, sf_dir, "documents")
    edited = docs.select("doc_id", "text", tokens.revision_edits(F.col("text"), F.col("doc_id")).alias("edits"))
    return tokens.count_edited(edited, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, common.read(spark, sf_dir, "documents"), size=2, percent=80)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, common.read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(common.read(spark, sf_dir, "documents"), SHARDS)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_rows(spark, common.read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest_rows(spark, common.read(spark, sf_dir, "documents"), MIN_LINE_DOCS, MIN_LINE_CHARS)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")
    return decontamination.contaminated(spark, docs, items).drop("row_key")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark, common.read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return toxicity.score_rows(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_token_counts": op1_edit_token_counts,
    "op2_packing": op2_packing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_sharding": op5_sharding,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
}

#: The white space of lines and words, as DuckDB takes it in trim().
_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A-Z only are lower-cased.
_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op7_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs
),
keyed AS (SELECT *, {_LOWER_SQL.format(f"trim(line, {_SPACE_SQL})")} AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= {MIN_LINE_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_LINE_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM hot)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM hot)), '')) AS kept_sha256
FROM keyed GROUP BY r""",
}
