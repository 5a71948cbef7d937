"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only used where the session names no shared folder and runs in one process (tests).
LOCAL_ROOT = "file:///tmp/checkpoints/stepquery"
#: Rows of a file of a table whose rows are counted beforehand.
ROWS_A_FILE = 100_000
#: Lists of the paths written since each open `scratch` began.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's own setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or LOCAL_ROOT).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialize` writes inside are deleted at the end, but for those to `keep`."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most `rows` rows, in so many partitions that it is not dealt out in many tiny files.

    On a local folder Hadoop runs `chmod` for each file, a child that seems as large as the executor until it starts.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    if not keep:
        for paths in _SCRATCH.get():
            paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_number(df: DataFrame, key: str) -> F.Column:
    """An id as a long. Ids of other types have no order that the operators could follow, and are refused."""
    kind = df.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"column {key} must hold whole numbers, not {kind.simpleString()}")
    return F.col(f"`{key}`").cast("long")


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of `df` has, whatever the case of its letters."""
    taken, k = {c.lower() for c in df.columns}, 0
    while any(f"_{k}_{i}" in taken for i in range(n)):
        k += 1
    return [f"_{k}_{i}" for i in range(n)]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices without copying, so that what is made from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_strings(column: pa.Array) -> list[str | None]:
    """Python strings; bytes that are no UTF-8 are replaced instead of ending the job."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
