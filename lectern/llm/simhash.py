"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A fingerprint is cut into more blocks than the radius has bits, so fingerprints within it agree on some blocks, and each
is put into a bucket for every choice of blocks: four 16-bit blocks for a radius of 3, five or six blocks of which two or
three make a key where more rows need smaller buckets. A bucket is sorted by population count and cut into tiles; numpy
compares tile with tile by exclusive-or and bit counts, and tile pairs whose population counts differ beyond the radius are
skipped, as are those whose rows are all linked already. Nothing is left out: every pair within the radius meets in some
bucket. A bucket above `SPLIT_ROWS` is dealt as pairs of parts over many tasks. Tasks return spanning links, not all pairs.

`similar_documents` serves a similarity instead of a radius; see there.

Equal fingerprints are one vertex, so copies never make pairs.

Cases: null and blank texts have no words and the fingerprint zero, which links like any other; a text of one or two words
has one shingle, the whole sequence; repeated doc_ids are separate rows of one id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import column, cut, released, shuffle_partitions, table
from .components import components, forest

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Rows that a bucket is planned for, rows above which a bucket is dealt over tasks, and rows of a tile.
BUCKET_ROWS, SPLIT_ROWS, TILE_ROWS = 2048, 16384, 1024
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text (runs without ASCII white space), in lists of about `size` bytes."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        if words := data[at:end].split():
            yield words
        at = end


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text's word shingles as an unsigned number."""
    counts = np.zeros(64, np.int64)
    n = 0
    carry: list[bytes] = []
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)
            n += len(h)
            for i in range(0, len(h), 1 << 15):
                counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if not n:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text")).mapInArrow(released(run), "doc_id long, fp long")


def _links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as fingerprints) that span what lies within the radius, between two sets or within one."""
    one = right is None
    fps = left if one else np.concatenate([left, right])
    side = np.zeros(len(fps), np.int8)
    side[len(left) :] = 1
    pops = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(pops, kind="stable")
    fps, pops, side = fps[order], pops[order], side[order]
    label = np.arange(len(fps))
    for i in range(0, len(fps), TILE_ROWS):
        a = fps[i : i + TILE_ROWS]
        for j in range(i, len(fps), TILE_ROWS):
            if int(pops[j]) - int(pops[min(i + TILE_ROWS, len(fps)) - 1]) > radius:
                break
            if (label[i : i + TILE_ROWS] == label[i]).all() and (label[j : j + TILE_ROWS] == label[i]).all():
                continue
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + TILE_ROWS]) <= radius
            if i == j:
                near = np.triu(near, 1)
            if not one:
                near &= side[i : i + TILE_ROWS, None] != side[None, j : j + TILE_ROWS]
            x, y = np.nonzero(near)
            if len(x):
                label = forest(len(fps), np.concatenate([np.arange(len(fps)), x + i]), np.concatenate([label, y + j]))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _blocks(n: int, radius: int) -> tuple[list[tuple[int, int]], int, int]:
    """Blocks (shift, width) of a fingerprint, how many of them make a key, and how many bits of a key are used for n rows.

    With radius + m blocks, fingerprints within the radius agree on m of them at least, so a table for each choice of m blocks
    loses nothing. More blocks in a key make buckets smaller and tables more; m is the least that keeps buckets near
    BUCKET_ROWS.
    """
    for m in range(1, 64 - radius):
        count = radius + m
        edges = [64 * i // count for i in range(count + 1)]
        blocks = [(i, j - i) for i, j in zip(edges, edges[1:])]
        bits = sum(sorted(w for _, w in blocks)[:m])
        if n >> bits <= BUCKET_ROWS:
            break
    return blocks, m, min(bits, max(0, (n - 1) // BUCKET_ROWS).bit_length())


def near_links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span all pairs within the radius among distinct fingerprints (column fp); n: their number."""
    blocks, m, bits = _blocks(n, radius)
    tables = list(combinations(blocks, m))

    def key(chosen: tuple[tuple[int, int], ...]) -> Column:
        value, size = F.lit(0).cast("long"), 0
        for shift, w in chosen:
            value = F.shiftleft(value, w) + F.shiftrightunsigned("fp", shift).bitwiseAND((1 << w) - 1)
            size += w
        return F.shiftrightunsigned(value, size - bits)

    rows = fps.select("fp", F.posexplode(F.array(*(key(x) for x in tables))).alias("table", "key")).select("fp", (F.col("key") * len(tables) + F.col("table")).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS)
    hot = sizes.select("bucket", F.ceil(F.col("n") / (SPLIT_ROWS // 2)).cast("int").alias("parts"))
    # A hot bucket's rows go to every pair of parts that theirs is in.
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = rows.join(hot, "bucket", "left").withColumn("part", F.coalesce(part, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    dealt = dealt.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "fp")

    def compare(t: pa.Table) -> pa.Table:
        f = t["fp"].to_numpy().view(np.uint64)
        part, p, q = t["part"].to_numpy(), t["p"][0].as_py(), t["q"][0].as_py()
        a, b = _links(f, None, radius) if p == q else _links(f[part == p], f[part == q], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("bucket", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id reachable over links)."""
    rows = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = distinct.count()
    roots = cut(components(near_links(distinct.select("fp").repartition(max(1, min(shuffle_partitions(docs.sparkSession), n // 10_000 + 1))), n, radius)))
    with_root = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = with_root.groupBy("root").agg(F.min("first").alias("component_id"))
    where = with_root.join(smallest, "root").select("fp", "component_id")
    return rows.join(where, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
