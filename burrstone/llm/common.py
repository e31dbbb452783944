"""Helpers of the llm operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrstone.session import ensure_importable

#: Fixed value: the white space of the word and line rules, \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Fixed rule: only A-Z are lower-cased.
LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows that Arrow hands to Python at once: documents may be long. Spark ends a batch by its bytes as well
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, and let its workers find this package."""
    ensure_importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str, barrier: bool = False) -> DataFrame:
    """mapInArrow over dicts of Python lists (column name to values), batch by batch, both ways."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ensure_importable(df.sparkSession)
    # The schema string is parsed on the driver; executors get the Arrow schema.
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[dict]:
            for b in batches:
                yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for out in rows(plain()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the name with marks that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in UTF-8: bytes know no other white space or capitals."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered; at() empties a full memory first."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def at(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared checkpoint folder and read again."""
    import uuid

    from burrstone.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
