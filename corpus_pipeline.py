"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; lines found in many documents go; one document of each group of near-duplicates (five-word
shingles, similarity 0.8) stays; documents that hold a benchmark item go; what is left is packed into sequences.
The stages before the last return the columns of documents. Nulls, repeated rows and empty tables are handled as the
operators say; a stage's result for an empty input is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.llm import common, decontamination, linededup, neardup, packing, toxicity
from burrstone.llm.queries import MIN_LINE_CHARS, MIN_LINE_DOCS, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject; it is fitted on this stage's documents."""
    common.prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them hold; n_chars follows the text."""
    common.prepare(spark)
    cleaned = linededup.clean_documents(spark, docs, MIN_LINE_DOCS, MIN_LINE_CHARS)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates."""
    common.prepare(spark)
    return neardup.keep_one(spark, docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean_documents(spark, docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences of at most 4096 tokens."""
    common.prepare(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express compression distances, alignment scores or packing; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared checkpoint folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(spark, docs, name)
    return docs
