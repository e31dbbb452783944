"""Text, packed binary and Matrix Market files of tuples, edges and arrays."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Cell formats of packed rows: name to (type code, bytes).
CELLS = {"long": ("<i8", 8), "double": ("<f8", 8), "int": ("<i4", 4)}
FORMATS = ("tsv", "bintsv4", "mm")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    from burrstone.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _bytes_at(spark: SparkSession, path: str) -> int:
    """Bytes of the data files at a path, by the store's own listing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return fs.getFileStatus(p).getLen()
    files = fs.listStatus(p)
    return sum(f.getLen() for f in files if not f.getPath().getName().startswith(("_", ".")))


# ---- text


def read_tsv(spark: SparkSession, path: str, names: Sequence[str], expected: int | None = None) -> DataFrame:
    """Tab-separated whole numbers; lines that start with # are comments. A stated row count is checked."""
    schema = StructType([StructField(n, LongType()) for n in names])
    df = spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="FAILFAST")
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{path} has {n} rows, not {expected}")
    return df


def read_words(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """White-space separated rows of any arity; empty lines and # comments are left out."""
    w = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(w.alias("w"))
    return lines.select(*[F.element_at("w", i + 1).cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t")


# ---- packed binary


def read_packed(spark: SparkSession, path: str, names: Sequence[str], cell: str = "long") -> DataFrame:
    """Rows of equal cells, little-endian, without a header. A size that is no whole number of rows is an error.

    Hadoop cuts large files at record borders, so one file is read by many tasks. Records reach Python as Arrow batches,
    and a batch is one array of cells there.
    """
    code, width = CELLS[cell]
    length = width * len(names)
    size = _bytes_at(spark, path)
    if size % length:
        raise ValueError(f"{path} has {size} bytes, which is no multiple of {length}")
    records = spark.sparkContext._jsc.binaryRecords(path, length).rdd()
    raw = DataFrame(spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            column = b.column(0)
            first = np.frombuffer(column.buffers()[1], "<i4")[column.offset] if len(column) else 0
            cells = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first : first + length * len(column)].view(code).reshape(-1, len(names))
            wide = cells.astype("f8" if cell == "double" else "i8", copy=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(wide[:, k])) for k in range(len(names))], names=list(names))

    return raw.mapInArrow(unpack, ", ".join(f"`{n}` {'double' if cell == 'double' else 'long'}" for n in names))


def write_packed(df: DataFrame, path: str, cell: str = "long") -> None:
    """One file of packed rows for each partition, renamed into place when it is whole, so a retried task leaves no
    torn file. The path must be one that pyarrow's file systems reach from every executor."""
    from pyarrow import fs as pafs

    dtype = CELLS[cell][0]
    # Hadoop's names of the S3 store are unknown to pyarrow, which calls it s3.
    uri = re.sub(r"^s3[an]://", "s3://", path) if "://" in path else path.removeprefix("file:")
    system, top = pafs.FileSystem.from_uri(uri)
    system.create_dir(top)

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.bin"
        part = f"{folder}/.{name}-{task.taskAttemptId()}"
        n = 0
        with store.open_output_stream(part) as out:
            for b in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                out.write(np.stack(columns, axis=1).astype(dtype).tobytes())
                n += b.num_rows
        store.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    df.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def text_to_packed(spark: SparkSession, source: str, target: str, fields: int, separators: str, burn: int = 0, cell: str = "long") -> None:
    """Text rows to packed rows: pieces between any of the separators, the first burn of them left out. A row of
    another arity or a piece that is no number is an error."""
    from burrstone.functions import tokens

    t = F.slice(tokens(F.col("value"), separators), burn + 1, 1 << 20)
    rows = spark.read.text(source).where(F.trim("value") != "").select(t.alias("t"))
    kind = "double" if cell == "double" else "long"
    checked = F.when(F.size("t") == fields, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("row of another arity: "), F.array_join("t", " "))))
    write_packed(rows.select(checked.alias("t")).select(*[F.element_at("t", i + 1).cast(kind).alias(f"f{i}") for i in range(fields)]), target, cell)


# ---- schema sidecar


def write_schema(spark: SparkSession, names: Sequence[str], types: Sequence[str], path: str) -> None:
    """Two lines: names, then types."""
    spark.createDataFrame([("\t".join(names) + "\n" + "\t".join(types),)], "value string").coalesce(1).write.text(path)


def read_schema(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    names, types = (r["value"].split("\t") for r in spark.read.text(path).limit(2).collect())
    return list(zip(names, types, strict=True))


# ---- Matrix Market


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, v of a coordinate file, values kept and symmetric entries expanded (skew ones negated). A pattern is 1."""
    # The first part by name holds the header, and the first line of a file that is no comment its sizes.
    place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", place.alias("at"))
    first = lines.agg(F.min_by("value", "at")).first()[0]
    head = (first or "").lower().split()
    if head[:3] != ["%%matrixmarket", "matrix", "coordinate"] or len(head) < 5 or head[3] not in ("real", "double", "integer", "pattern"):
        raise ValueError(f"{path}: not a coordinate matrix of a known field: {' '.join(head)}")
    symmetry = head[4]
    data = lines.where(~F.col("value").rlike(r"^\s*(%|$)"))
    sizes = data.agg(F.min("at").alias("first"))
    w = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    entries = data.crossJoin(F.broadcast(sizes)).where("at > first").select(w.alias("w")).select(
        F.element_at("w", 1).cast("long").alias("i"), F.element_at("w", 2).cast("long").alias("j"),
        (F.lit(1.0) if head[3] == "pattern" else F.element_at("w", 3).cast("double")).alias("v"),
    )
    if symmetry == "general":
        return entries
    sign = -1.0 if symmetry == "skew-symmetric" else 1.0
    return entries.union(entries.where("i <> j").select("j", "i", F.col("v") * sign))


def write_matrix(entries: DataFrame, path: str, symmetry: str = "general", note: str | None = None) -> None:
    """A coordinate matrix in parts: the first part has the header and the sizes, the others the entries, each sorted.
    Joined in order of their names the parts are one file of the format. Of a symmetric matrix one triangle is given."""
    s = entries.agg(F.max("i"), F.max("j"), F.count(F.lit(1))).first()
    lines = [f"%%MatrixMarket matrix coordinate real {symmetry}", *([f"% {note}"] if note else []), f"{s[0] or 0} {s[1] or 0} {s[2]}"]
    head = entries.sparkSession.createDataFrame([(line,) for line in lines], "value string")
    body = entries.sortWithinPartitions("i", "j").select(F.concat_ws(" ", "i", "j", "v").alias("value"))
    head.coalesce(1).union(body).write.text(path)


# ---- edges by format


def load_edges(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """src, dst of an edge file: tsv, bintsv4 (pairs of 32-bit cells) or mm / mtx (1-based rows and columns)."""
    if fmt == "tsv":
        return read_tsv(spark, path, ["src", "dst"])
    if fmt == "bintsv4":
        return read_packed(spark, path, ["src", "dst"], "int")
    if fmt in ("mm", "mtx"):
        return read_matrix(spark, path).select((F.col("i") - 1).alias("src"), (F.col("j") - 1).alias("dst"))
    raise ValueError(f"unknown edge format {fmt}; known: {', '.join(FORMATS)}")


def save_edges(edges: DataFrame, path: str, fmt: str) -> None:
    e = edges.select("src", "dst")
    if fmt == "tsv":
        write_tsv(e, path)
    elif fmt == "bintsv4":
        write_packed(e, path, "int")
    elif fmt in ("mm", "mtx"):
        write_matrix(e.select((F.col("src") + 1).alias("i"), (F.col("dst") + 1).alias("j"), F.lit(1.0).alias("v")), path)
    else:
        raise ValueError(f"unknown edge format {fmt}; known: {', '.join(FORMATS)}")


def save_roots(edges: DataFrame, path: str, count: int = 64) -> None:
    """The roots of a search benchmark beside its edges: the vertices of largest out-degree (the least ids of those), as
    packed cells in no stated order."""
    write_packed(edges.groupBy("src").count().orderBy(F.desc("count"), "src").limit(count).select("src"), path)


def load_roots(spark: SparkSession, path: str) -> DataFrame:
    return read_packed(spark, path, ["id"])


def convert_edges(spark: SparkSession, source: str, source_fmt: str, target: str, target_fmt: str) -> None:
    save_edges(load_edges(spark, source, source_fmt), target, target_fmt)


# ---- arrays


def write_array(df: DataFrame, path: str, pieces: int) -> None:
    """An indexed array (idx, value) as pieces in order of idx; each row is written with its index."""
    write_packed(df.select("idx", "value").repartitionByRange(pieces, "idx").sortWithinPartitions("idx"), path)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    return read_packed(spark, path, ["idx", "value"])


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics as lines of JSON."""
    df.write.json(path)
