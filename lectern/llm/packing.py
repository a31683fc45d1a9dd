"""Best-fit packing of token pieces into sequences by minimum bin slack.

Pieces of one length are interchangeable, so the plan is made on the histogram of lengths, which has at most
`max_tokens` rows whatever the input. For each bin the greatest length left opens it, and a subset-sum program on a bitset
over the lengths left (with how many there are) finds the fullest combination that fits, which is removed. A combination
that can be taken again is taken as often as the counts allow, so a plan has some thousand steps at most.

Pieces get their places by rank within their length: the plan says which ranks go to which step, copy and offset.

Cases: a null text is empty; an empty text is the end id alone; a text longer than `max_tokens` is cut into pieces, the
last of which may be shorter; repeated doc_ids are separate documents; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import column, cut, released, table
from .word_tokens import encoder

MAX_TOKENS = 2048
END_ID = 0
#: Rows that a part for ranking is planned for.
RANK_ROWS = 50_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Of lengths (descending, counts > 0), the combination with the greatest sum up to `room`, as length: times.

    Bit s of a reach is set if a sum of s is reachable with the lengths so far. The program ends once `room` is reached.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for x in lengths:
        if x > room:
            continue
        k, have = 1, min(counts[x], room // x)
        while have and not reach >> room & 1:  # 1, 2, 4, ... copies at once give every number of copies
            k = min(k, have)
            steps.append((x, k, reach))
            reach |= reach << (x * k) & mask
            have -= k
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for x, k, was in reversed(steps):
        if not was >> at & 1:
            at -= x * k
            taken[x] = taken.get(x, 0) + k
    return taken


def plan(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[int, dict[int, int]]]:
    """Steps (times, combination) that use up the histogram (length: pieces)."""
    left = {x: int(n) for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= size for x in left):
        raise ValueError("a piece is longer than a sequence")
    order = sorted(left, reverse=True)
    steps = []
    while order:
        first = order[0]
        left[first] -= 1
        got = fullest([x for x in order if left[x] > 0], left, size - first)
        left[first] += 1
        got[first] = got.get(first, 0) + 1
        times = min(left[x] // k for x, k in got.items())
        for x, k in got.items():
            left[x] -= k * times
        order = [x for x in order if left[x] > 0]
        steps.append((times, got))
    return steps


def _places(steps: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, copies in a sequence, offset of the first copy), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    base = 0
    for times, got in steps:
        at = 0
        for x in sorted(got, reverse=True):
            k = got[x]
            rows.setdefault(x, []).append((used.get(x, 0), base, k, at))
            used[x] = used.get(x, 0) + k * times
            at += x * k
        base += times
    return {x: np.array(v, np.int64) for x, v in rows.items()}


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces; row is a number of the row's own within its table's partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, out = b.column(0), ([], [], [], [], [])
            for i, ids_of in enumerate(enc.encode_all(x.as_py() or "" for x in b.column(1))):
                raw = ids_of + END_ID.to_bytes(4, "little")
                view = memoryview(raw)
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    piece = view[at : at + 4 * size]
                    for col, v in zip(out, (i, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text")).mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = cut(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    places = spark.sparkContext.broadcast(_places(plan(histogram, size)))  # some thousand rows
    parts = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    # A rank is a number within (length, part) plus the earlier parts' rows: no length gathers in one task.
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    before = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "part", "before")
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                p = places.value[int(x)]
                row = p[np.searchsorted(p[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                seq[at] = row[:, 1] + nth // row[:, 2]
                off[at] = row[:, 3] + nth % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(released(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    return pack(token_pieces(docs, path or vocabulary(), **names))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
