"""What the operators share: result columns beside a table's own, and the shared folder."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that a Python worker gets at once: its memory follows them.
BATCH_ROWS = 1000


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores after it until no column has it, in whatever case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns most operators need, under fixed names; other columns don't matter, whatever their names. Ids are integers of any width, long from here on; others raise a TypeError."""
    small_batches(docs.sparkSession)
    got = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = got.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must hold integers, not {kind.simpleString()}")
    return got if isinstance(kind, T.LongType) else got.withColumn("doc_id", F.col("doc_id").cast("long"))


def with_result(docs: DataFrame, text_col: str, name: str, result: T.StructType, fn: Callable[[pa.RecordBatch, str], Iterator[tuple[pa.RecordBatch, pa.StructArray]]]) -> tuple[DataFrame, str]:
    """`docs` with one more struct column, and that column's name; `fn` gets batches and the text column's name, and gives parts of them with their results."""
    small_batches(docs.sparkSession)
    out = fresh(name, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in fn(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema), out


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (two columns) with the text compressed: for joins that move texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [pack(t.as_buffer()) if t.is_valid else None for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, packed binary")


def unpacked_rows(batch: pa.RecordBatch, columns: tuple[int, ...], limit: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For parts of about `limit` bytes of a batch: the first row, and the bytes and row bounds of each packed column; null texts are empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[list[bytes]] = [[] for _ in columns]
    first = size = 0

    def part() -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        return first, [(np.frombuffer(b"".join(h), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in h])]).astype(np.int64)) for h in held]

    for i in range(batch.num_rows):
        for into, c in zip(held, columns, strict=True):
            value = batch.column(c)[i]
            into.append(unpack(value.as_buffer()) if value.is_valid else b"")
            size += len(into[-1])
        if size >= limit:
            yield part()
            held, first, size = [[] for _ in columns], i + 1, 0
    if held[0]:
        yield part()


class Shared:
    """An object of this subpackage as a broadcast that workers can read without the package; its size is the caller's to bound."""

    def __init__(self, spark: SparkSession, value: Any):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self) -> Any:
        return pickle.loads(self.sent.value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of this machine only where none is set, as in tests."""
    sc = spark.sparkContext
    got = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = tempfile.mkdtemp(prefix="plumeline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(got)
    return got


def shards_for(df: DataFrame, size: int) -> int:
    """Parts for data as large as `df`'s files, of `size` bytes each; two for each shuffle partition at least, 64 at most."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    measured = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * partitions, min(64 * partitions, measured // size))


def in_order(df: DataFrame) -> DataFrame:
    """`df`, whose rows come in the same order if a task runs again: as they are from files, sorted after a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.sortWithinPartitions(*df.columns) if "Exchange" in plan else df


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables kept in the shared folder while an operator runs; they go when it is done."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path, self.n = spark, shared_path(spark, kind), 0

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error: object) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
