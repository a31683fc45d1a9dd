"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut as cut
from ..plans.session import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, so that other columns' names (dots, case) cannot clash with it."""
    return df["`" + name.replace("`", "``") + "`"]


def row_key(df: DataFrame, *names: str) -> Column:
    """16 bytes that tell rows of different values in these columns apart, nulls included. Equal rows have equal keys."""
    cols = [x for n in names for x in (column(df, n), column(df, n).isNull())]
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(*salt, *cols)), 16, "0") for salt in ([], [F.lit("again")]))))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of about so many narrow rows, in no more partitions than they need: each costs a task and a file when it is written."""
    return df.coalesce(max(1, min(shuffle_partitions(df.sparkSession), rows // 20_000 + 1)))


def release() -> None:
    """Gives memory that nothing uses back to the machine. Workers outlive their tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, with `release` at the task's end."""

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def to_blob(batch: pa.Table) -> bytes:
    """A table as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(batch)
    return sink.getvalue().to_pybytes()


def batches_of(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    """Arrow batches joined up to about `max_bytes`; a batch above it is halved until one row is left."""
    held: list[pa.RecordBatch] = []
    size = 0
    todo: list[pa.RecordBatch] = []
    for batch in batches:
        todo.append(batch)
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > max_bytes:
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]
                continue
            if held and size + x.nbytes > max_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            if x.num_rows:
                held.append(x)
                size += x.nbytes
    if held:
        yield pa.Table.from_batches(held)


def utf8_length(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
