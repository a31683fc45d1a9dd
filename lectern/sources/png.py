"""Text chunks of PNG files, from rows of bytes. One Arrow pass: Spark has no expression for a walk whose steps depend on the data."""

from __future__ import annotations

import os
import struct
import warnings
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The signature, and the message for other files.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NOT_A_PNG = "not a PNG file (bad signature)"

_CHUNK = pa.struct([("ordinal", pa.int32()), ("keyword", pa.string()), ("text", pa.string()), ("chunk_type", pa.string())])
CHUNKS = "array<struct<ordinal:int,keyword:string,text:string,chunk_type:string>>"


def _inflated(method: int, data: bytes) -> bytes:
    if method:
        raise ValueError("unknown compression")
    return zlib.decompress(data)


def _text_of(kind: bytes, body: bytes) -> tuple[str, str] | None:
    """Keyword and text of a text chunk; None for other kinds. Raises where it is malformed."""
    if kind not in (b"tEXt", b"zTXt", b"iTXt"):
        return None
    keyword, nul, rest = body.partition(b"\0")
    if not nul:
        raise ValueError("no keyword")
    if kind == b"tEXt":
        return keyword.decode("latin-1"), rest.decode("latin-1")
    if kind == b"zTXt":
        return keyword.decode("latin-1"), _inflated(rest[0], rest[1:]).decode("latin-1")
    packed, method = rest[0], rest[1]
    tag_and_translated = rest[2:].split(b"\0", 2)
    if len(tag_and_translated) < 3:
        raise ValueError("no language tag")
    raw = tag_and_translated[2]
    return keyword.decode("utf-8", "replace"), (_inflated(method, raw) if packed == 1 else raw).decode("utf-8", "replace")


def text_chunks(data: bytes) -> list[tuple[int, str, str, str]]:
    """(ordinal, keyword, text, kind) of every sound text chunk up to IEND; malformed ones are left out, a cut-off end is no error."""
    if not data.startswith(SIGNATURE):
        raise ValueError(NOT_A_PNG)
    out: list[tuple[int, str, str, str]] = []
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            break
        try:
            if found := _text_of(kind, data[at + 8 : at + 8 + size]):
                out.append((len(out), *found, kind.decode()))
        except (ValueError, IndexError, zlib.error):
            pass
        if kind == b"IEND":
            break
        at += 12 + size
    return out


def with_chunks(files: DataFrame) -> DataFrame:
    """`files` with chunks (null for a failure) and error in place of content. Other columns pass through as they are."""
    kept = [c for c in files.columns if c != "content"]
    types = dict(files.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks, errors = [], []
            for x in b.column(len(kept)):
                try:
                    chunks.append([dict(zip(("ordinal", "keyword", "text", "chunk_type"), c, strict=True)) for c in text_chunks(x.as_py() or b"")])
                    errors.append(None)
                except Exception as e:  # a bad file is a row of failures, not the end of the batch
                    chunks.append(None)
                    errors.append(str(e) if str(e) == NOT_A_PNG else f"unexpected error: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(chunks, pa.list_(_CHUNK)), pa.array(errors, pa.string())], names=[*kept, "chunks", "error"])

    quoted = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return files.select(*(F.col(f"`{c}`") for c in kept), F.col("content").cast("binary").alias("content")).mapInArrow(run, f"{quoted}, chunks {CHUNKS}, error string")


def scan(spark: SparkSession, inputs: list[str], recursive: bool = True, any_case: bool = False) -> DataFrame:
    """ord, path, chunks, error of PNG files: folders give their *.png files (*.PNG too with any_case), sorted by path parts;
    files themselves, whatever their name. Paths that are not there are skipped with a warning; a file given twice counts once,
    where it came first.

    Paths are listed and numbered without their content; bytes are walked in the task that reads them, and only the chunks
    found are joined to the numbers.
    """
    sc = spark.sparkContext
    paths = sc._jvm.org.apache.hadoop.fs
    conf = sc._jsc.hadoopConfiguration()
    found = []
    for number, name in enumerate(inputs):
        p = paths.Path(_resolved(name))
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            warnings.warn(f"no such path, left out: {name}", stacklevel=2)
            continue
        reader = spark.read.format("binaryFile")
        if fs.getFileStatus(p).isDirectory():
            reader = reader.option("pathGlobFilter", "*.[pP][nN][gG]" if any_case else "*.png").option("recursiveFileLookup", str(bool(recursive)).lower())
        found.append(reader.load(p.toString()).select(F.lit(number).alias("input"), "path", "content"))
    if not found:
        return spark.createDataFrame([], f"ord long, path string, chunks {CHUNKS}, error string")
    files = reduce(DataFrame.unionByName, found)
    numbers = ordered_paths(files.select("input", "path"), keep_input=True)
    return with_chunks(files).join(numbers, ["input", "path"]).select("ord", "path", "chunks", "error")


def _resolved(name: str) -> str:
    """A local path without links and dots, so that two ways to a file are one; other file systems' paths as they are."""
    scheme, _, rest = name.rpartition("://")
    return name if scheme and scheme != "file" else f"file://{os.path.realpath(rest)}" if scheme else os.path.realpath(name) if os.path.exists(name) else name


def first_of_each(rows: DataFrame) -> DataFrame:
    """Rows (input, path, ...) of which each path stays once, where it came first."""
    first = rows.groupBy("path").agg(F.min("input").alias("input"))
    return rows.join(first, ["path", "input"]).dropDuplicates(["path", "input"])


def ordered_paths(rows: DataFrame, keep_input: bool = False) -> DataFrame:
    """`first_of_each` with ord, by input and then by path parts."""
    from ..operators.select import numbered

    once = first_of_each(rows).withColumn("parts", F.split("path", "/"))
    return numbered(once, [F.asc("input"), F.asc("parts")], "ord").select("ord", *(c for c in once.columns if c != "parts" and (keep_input or c != "input")))
