"""The folder that driver and executors share, and new paths in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; one of this machine only where none is set on a local master, as in tests."""
    sc = spark.sparkContext
    got = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="plumeline-")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again: what it was made from may go."""
    path = new_path(spark, "kept")
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def watched(path: str) -> str:
    """A pattern for just this path, so that a stream takes a folder of files or a single one."""
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


#: Bytes of the files that one part of dealt rows comes from.
PART_BYTES = 2 << 20
#: Sizes from here on aren't those of files.
UNKNOWN_BYTES = 1 << 60


def parts_of(rows: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Into how many parts dealt() deals rows: as many as their files are large, one for each shuffle partition at least.

    Of rows that come from no file Spark says the greatest size there is; they count as nothing."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(s for k in range(leaves.size()) if (s := int(str(leaves.apply(k).stats().sizeInBytes()))) < UNKNOWN_BYTES)
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // part_bytes + 1, 1 << 16))


def dealt(rows: DataFrame, key: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows by hash of a key, in parts_of() them: what a task holds of a key's groups doesn't grow with the table."""
    return rows.repartition(parts_of(rows, part_bytes), key)
