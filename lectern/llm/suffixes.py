"""Suffix-array deduplication of byte strings by bucket-pointer refinement.

Every byte covered by a string of `LENGTH` bytes that also starts in a document with a smaller id is removed.

1. Of each document's strings of LENGTH bytes, consecutive ones with the same least hash of `GRAM` bytes form a run. Equal
   strings have equal least hashes, so only runs whose hash occurs in two rows can hold repeats. Hashes are dealt to
   buckets, 4 bytes each; what is found twice is told to the parts of the documents it came from.
2. Parts send those runs' bytes, each distinct one once with its smallest id, to the hash's bucket.
3. A bucket refines: suffixes start in buckets by their first q bytes, and are sorted on the bucket identifiers at later
   offsets until LENGTH bytes agree. Each bucket's smallest id tells which strings go.
4. Parts remove what is covered.

Texts move only as compressed parts. No key gathers rows: a hash or run counts once for each part, equal texts are settled by
their digest first, and hashes met in more than `HOT` parts are dealt on as single strings by their own hash. A run that
repeats itself is sent as one period.

Cases: a null text is empty; texts below LENGTH bytes lose nothing; rows with equal ids do not count as earlier than each
other; rows with a null id lose nothing, count for nobody and take no part in any exchange; an empty table gives an empty result; other columns are
kept by `remove_repeats`, where they do not clash with what it adds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import batches_of, column, cut, release, released, table, to_blob, utf8_length

LENGTH, GRAM = 50, 20
#: Bytes of text that a part, and a bucket of runs, are planned for.
PART_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
#: Parts that meet a hash before it is dealt on as single strings.
HOT = 4096
#: Bytes of the first buckets' prefixes.
Q = 25
#: Bytes of text that numpy works on at once; a longer document is cut there, with LENGTH - 1 bytes in common.
BLOCK = 1 << 18
#: Bytes of text whose hashes are sent together, and that are packed together.
SEND_BYTES, PACK_BYTES = 2 << 20, 8 << 20


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as compressed bytes with 4 bytes for each one's length: little beside even one entry."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(b"".join([np.array([len(x) for x in raw], "<u4").tobytes(), *raw]))


def _unpack(raw: bytes, *types: type | None) -> list[np.ndarray | bytes]:
    """The arrays of `_pack`; a type of None leaves the bytes."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    ends = np.cumsum(np.append(4 * len(types), np.frombuffer(data, "<u4", len(types)).astype(np.int64))).tolist()
    parts = [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    return [x if t is None else np.frombuffer(x, t) for x, t in zip(parts, types, strict=True)]


def _words(buf: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of the first n places as numbers; `buf` holds n + 7 bytes at least."""
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        m = (n - r + 7) // 8
        out[r::8] = np.frombuffer(buf, "<u8", m, r)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(words: np.ndarray, n: int, width: int) -> np.ndarray:
    """64-bit hashes of the `width` (8 at least) bytes at each of the first n places."""
    h = _mix(words[:n])
    for at in [*range(8, width - 7, 8), *([width - 8] if width % 8 else [])]:
        h ^= words[at : at + n]
        h = _mix(h)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, for len(x) - width + 1 places."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of LENGTH bytes with one least hash: text number, first string's start, strings, hash."""
    pieces: list[tuple[int, int, bytes]] = []
    out: list[tuple[np.ndarray, ...]] = []
    size = 0

    def finish() -> None:
        data = b"".join(x for _, _, x in pieces)
        n = len(data) - LENGTH + 1
        w = _words(np.frombuffer(data + bytes(8), np.uint8), len(data))
        least = _sliding_min(gram_hashes(w, len(data) - GRAM + 1, GRAM), LENGTH - GRAM + 1)
        lens = np.array([len(x) for _, _, x in pieces])
        ends = np.cumsum(lens)
        inside = np.ones(n, np.bool_)
        for e in ends[:-1].tolist():
            inside[max(0, e - LENGTH + 1) : e] = False
        new = np.empty(n, np.bool_)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
        piece = np.searchsorted(ends, first, side="right")
        base = ends - lens
        out.append((np.array([t for t, _, _ in pieces])[piece], first - base[piece] + np.array([o for _, o, _ in pieces])[piece], stop - first, least[first]))

    for t, x in enumerate(texts):
        for at in range(0, len(x) - LENGTH + 1, BLOCK):
            piece = x[at : at + BLOCK + LENGTH - 1]
            pieces.append((t, at, piece))
            size += len(piece)
            if size > BLOCK:
                finish()
                pieces, size = [], 0
    if pieces:
        finish()
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def _names(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys among the distinct ones."""
    order = np.argsort(keys)
    new = np.empty(len(keys), np.bool_)
    new[:1] = False
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def refine(data: bytes, starts: np.ndarray, depth: int = LENGTH, q: int = Q) -> np.ndarray:
    """Bucket of the `depth` bytes at each start (sorted, distinct): equal buckets hold equal strings.

    Suffixes first get the bucket of their q-gram, then repeatedly that of (own bucket, bucket at the depth reached), each
    round with the buckets of the round before. q-gram keys over 8 bytes are hashes, so the result is held against the bytes;
    should it fail, buckets start over from 8-grams, which are exact.
    """
    n = len(data)
    words = _words(np.frombuffer(data + bytes(depth + 8), np.uint8), n + depth)
    steps, d = [], q
    while d < depth:
        steps.append(min(d, depth - d))
        d += steps[-1]
    needed = [starts]
    for s in reversed(steps):
        mask = np.zeros(n + depth, np.bool_)
        mask[needed[-1]] = True
        mask[needed[-1] + s] = True
        needed.append(np.flatnonzero(mask))
    at = needed.pop()
    bucket = np.zeros(n + depth, np.int32)
    bucket[at] = _names(gram_hashes(words, n + depth - q, q)[at] if q != 8 else words[at])
    for s in steps:
        at = needed.pop()
        bucket[at] = _names(bucket[at].astype(np.uint64) << np.uint64(32) | bucket[at + s].astype(np.uint64))
    found = bucket[starts]
    if q > 8:
        head = np.zeros(int(found.max(initial=-1)) + 1, np.int64)
        head[found] = starts
        heads = head[found]
        for o in [*range(0, depth - 7, 8), depth - 8]:
            if not np.array_equal(words[starts + o], words[heads + o]):
                return refine(data, starts, depth, 8)
    return found


class _Part:
    """The runs of a part's rows that may repeat, each distinct one numbered. Rows must be sorted by id."""

    def __init__(self, ids: list[int], texts: list[bytes], wanted: np.ndarray, hot: np.ndarray, buckets: int) -> None:
        t, start, count, h = runs(texts)
        key = _bucket(h, buckets).astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        kept = np.isin(key, wanted, assume_unique=False)
        is_hot = np.isin(key[kept], hot)
        self.number: dict[bytes, int] = {}
        self.least: list[int] = []
        self.bucket: list[int] = []
        self.where: list[tuple[int, int, int, int, int]] = []  # row, start, end of the strings' starts, number, period
        for i, s, n, k, single in zip(t[kept].tolist(), start[kept].tolist(), count[kept].tolist(), (key[kept] >> np.uint64(32)).tolist(), is_hot.tolist(), strict=True):
            # Of a run that repeats itself only one period's strings are told apart and sent.
            period = _period(texts[i][s : s + n + LENGTH - 1]) if n > LENGTH else 0
            for at, m in ((j, 1) for j in range(s, s + (period or n))) if single else ((s, period or n),):
                raw = texts[i][at : at + m + LENGTH - 1]
                no = self.number.setdefault(raw, len(self.number))
                if no == len(self.least):
                    self.least.append(ids[i])
                    self.bucket.append(zlib.crc32(raw) % buckets if single else k)
                self.where.append((i, at, s + n if period else at + m, no, period))

    def spread(self, at: int, end: int, period: int, off: int, m: int) -> Iterator[tuple[int, int]]:
        """Ranges (start, strings) of a place in `where` that m strings from `off` of its number stand for."""
        if not period:
            yield at + off, m
        elif m >= period:
            yield at, end - at
        else:
            yield from ((j, min(m, end - j)) for j in range(at + off, end, period))


def _period(raw: bytes) -> int:
    """The least period up to LENGTH - GRAM + 1 that a run's bytes have; 0 without one."""
    return next((p for p in range(1, LENGTH - GRAM + 2) if raw[p : p + LENGTH] == raw[:LENGTH] and raw[p:] == raw[:-p]), 0)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_TOLD = "part int, kind int, key long, data binary"
_COPY, _WANTED, _HOT, _GONE = 0, 1, 2, 3
#: What a part sends of runs (numbers, least ids, lengths, bytes) and hears of ranges (numbers, offsets, strings).
_RUNS, _RANGES = (np.int32, np.int64, np.int32, None), (np.int32, np.int32, np.int32)


def _hashes(parts: int, buckets: int):
    """Rows (bucket, hashes, parts) of each stretch of texts: each hash once for each part, twice if two rows of a part have it."""
    kind = np.uint16 if parts <= 1 << 16 else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches_of(batches, SEND_BYTES):
            part = t["part"].to_numpy().astype(np.int64)
            row, _, _, h = runs([x.as_py() or b"" for x in t["text"]])
            if not len(h):
                continue
            order = np.lexsort((row, part[row], h))
            h, row = h[order], row[order]
            p = part[row]
            new_part = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
            new_row = np.append(True, row[1:] != row[:-1]) | new_part
            # Of a (hash, part), at most two entries stay: two mean two rows.
            nth = np.cumsum(new_row) - np.maximum.accumulate(np.where(new_part, np.cumsum(new_row), 0))
            kept = new_row & (nth < 2)
            h, p = h[kept], p[kept]
            b = _bucket(h, buckets)
            order = np.argsort(b, kind="stable")
            low, p, b = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], p[order].astype(kind), b[order]
            at = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(b[at[:-1]], pa.int32()), pa.array([low[i:j].tobytes() for i, j in zip(at, at[1:])]), pa.array([p[i:j].tobytes() for i, j in zip(at, at[1:])])], names=["bucket", "hashes", "parts"])

    def repeated(t: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t["hashes"]])
        p = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t["parts"]])
        order = np.argsort(low, kind="stable")
        low, p = low[order], p[order]
        first = np.append(True, low[1:] != low[:-1])
        group = np.cumsum(first) - 1
        n = np.bincount(group)[group]
        out: list[tuple] = []
        for what, mask in ((_WANTED, n > 1), (_HOT, n > HOT)):
            lo, pp = low[mask], p[mask]
            order = np.lexsort((lo, pp))
            lo, pp = lo[order], pp[order]
            at = np.append(np.flatnonzero(np.append(True, pp[1:] != pp[:-1])), len(pp)).tolist() if len(pp) else [0]
            out += [(int(pp[i]), what, lo[i:j].tobytes()) for i, j in zip(at, at[1:])]
        bucket = t["bucket"][0].as_py()
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int32()), "key": pa.array([bucket] * len(out), pa.int64()), "data": pa.array([x[2] for x in out], pa.binary())})

    return run, repeated


def _read(rows: pa.Table, told: pa.Table, buckets: int) -> tuple[pa.Table, list[int], list[bytes], _Part, list[bool], dict[int, list[tuple[int, int]]]]:
    """A part's rows by id, its runs, which rows are copies, and ranges that go, from what it was told."""
    found = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows["blob"]]
    t = pa.concat_tables(found).sort_by("doc_id__")
    kind, key = told["kind"].to_pylist(), told["key"].to_pylist()
    copies: dict[int, set[bytes]] = {}
    for w, k, x in zip(kind, key, told["data"], strict=True):
        if w == _COPY:
            copies.setdefault(k, set()).add(x.as_py())

    def keys(what: int) -> np.ndarray:
        got = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(k << 32) for w, k, x in zip(kind, key, told["data"], strict=True) if w == what]
        return np.concatenate(got) if got else np.empty(0, np.uint64)

    ids = t["doc_id__"].to_pylist()
    # Rows of one id can have different texts, so a note holds for the text it names.
    copied = [i in copies and hashlib.sha256(x.as_py() or b"").digest() in copies[i] for i, x in zip(ids, t["text__"], strict=True)]
    texts = [b"" if i is None or c else x.as_py() or b"" for i, c, x in zip(ids, copied, t["text__"], strict=True)]
    part = _Part(ids, texts, keys(_WANTED), keys(_HOT), buckets)
    gone: dict[int, list[tuple[int, int]]] = {}
    for w, x in zip(kind, told["data"], strict=True):
        if w == _GONE:
            for no, off, n in zip(*(c.tolist() for c in _unpack(x.as_py(), *_RANGES)), strict=True):
                gone.setdefault(no, []).append((off, n))
    return t, ids, texts, part, copied, gone


def _spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal [start, end) of strings given as (first start, number)."""
    out: list[list[int]] = []
    for s, n in sorted(ranges):
        e = s + n + LENGTH - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without characters that they only cover in part."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """Rows of `docs` with their text less what repeats, and n_bytes, n_removed, n_spans, kept_sha256.

    The text loses whole characters only, so that it stays valid; the numbers and the digest are those of the bytes.
    With digest_only the result has the id and those four alone.
    """
    spark = docs.sparkSession
    text, doc_id = column(docs, text_col), column(docs, id_col).cast("long")
    raw = text.cast("binary")
    # Rows are dealt by id and text, so that rows of one id spread; rows without an id are told nothing and need no part.
    row = F.xxhash64(doc_id, raw)
    digests = cut(docs.select(doc_id.alias("doc_id"), row.alias("row"), utf8_length(text).alias("n"), F.unhex(F.sha2(F.coalesce(raw, F.lit(b"")), 256)).alias("digest")))
    total, rows = digests.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-(int(total) + 64 * rows) // PART_BYTES))
    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    part = F.pmod(row, F.lit(parts)).cast("int")
    first = digests.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    copies = digests.join(first, "digest").where("doc_id > first").select(F.pmod("row", F.lit(parts)).cast("int").alias("part"), F.lit(_COPY).alias("kind"), F.col("doc_id").alias("key"), F.col("digest").alias("data"))

    hashes, repeated = _hashes(parts, buckets)
    seen = docs.where(doc_id.isNotNull()).select(part.alias("part"), raw.alias("text")).mapInArrow(released(hashes), "bucket int, hashes binary, parts binary")
    told = cut(copies.unionByName(seen.groupBy("bucket").applyInArrow(repeated, _TOLD)))

    others = [] if digest_only else [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    carried = docs.select(part.alias("part__"), doc_id.alias("doc_id__"), raw.alias("text__"), *(column(docs, c).alias(f"c{i}") for i, c in enumerate(others)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches_of(batches, PACK_BYTES):
            p = t["part__"].to_numpy()
            order = np.argsort(p, kind="stable")
            p, t = p[order], t.drop_columns("part__").take(pa.array(order))
            at = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p)).tolist()
            for i, j in zip(at, at[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([p[i]], pa.int32()), pa.array([to_blob(t.slice(i, j - i))], pa.binary())], names=["part", "blob"])

    packed = carried.where("doc_id__ is not null").mapInArrow(released(pack), "part int, blob binary")

    def send(rows: pa.Table, told: pa.Table) -> pa.Table:
        names = ["bucket", "part", "blob"]
        if not rows.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=names)
        *_, own, _, _ = _read(rows, told, buckets)
        b, least, raws = np.array(own.bucket, np.int64), np.array(own.least, np.int64), list(own.number)
        lens = np.array([len(x) for x in raws], np.int32)
        order = np.argsort(b, kind="stable")
        b = b[order]
        at = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)).tolist() if len(b) else [0]
        number = rows["part"][0].as_py()
        release()
        return pa.table([pa.array(b[at[:-1]], pa.int32()), pa.array([number] * (len(at) - 1), pa.int32()), pa.array([_pack(o.astype(np.int32), least[o], lens[o], b"".join([raws[k] for k in o.tolist()])) for o in (order[i:j] for i, j in zip(at, at[1:]))], pa.binary())], names=names)

    def settle(t: pa.Table) -> pa.Table:
        found = [_unpack(x.as_py(), *_RUNS) for x in t["blob"]]
        whose = np.repeat(np.array(t["part"].to_pylist()), [len(x[0]) for x in found])
        number, least, lens = (np.concatenate([x[k] for x in found]) for k in range(3))
        lens = lens.astype(np.int64)
        data = b"".join(x[3] for x in found)
        del found
        count = lens - LENGTH + 1
        base = np.cumsum(lens) - lens
        run = np.repeat(np.arange(len(lens), dtype=np.int32), count)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        bucket = refine(data, base[run] + offset)
        low = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, bucket, least[run])
        gone = np.flatnonzero(low[bucket] < least[run])
        new = np.append(True, (run[gone][1:] != run[gone][:-1]) | (offset[gone][1:] != offset[gone][:-1] + 1)) if len(gone) else np.empty(0, np.bool_)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(gone)))
        head = gone[at] if len(at) else at
        p = whose[run[head]]
        order = np.argsort(p, kind="stable")
        p, out = p[order], [x.astype(np.int32)[order] for x in (number[run[head]], offset[head], n)]
        at = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p)).tolist() if len(p) else [0]
        m = len(at) - 1
        del data, bucket, run, offset
        release()
        return pa.table([pa.array(p[at[:-1]], pa.int32()), pa.array([_GONE] * m, pa.int32()), pa.array([0] * m, pa.int64()), pa.array([_pack(*(x[i:j] for x in out)) for i, j in zip(at, at[1:])], pa.binary())], names=["part", "kind", "key", "data"])

    sent = packed.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(send, "bucket int, part int, blob binary")
    gone = sent.groupBy("bucket").applyInArrow(settle, _TOLD)

    fields = {f.name: f for f in docs.schema.fields}
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([T.StructField(id_col, T.LongType()), *added] if digest_only else [*(T.StructField(f"c{i}", fields[c].dataType) for i, c in enumerate(others)), T.StructField("text__", T.StringType()), *added])

    def results(t: pa.Table, spans_of: Callable[[int, int], list[tuple[int, int]]]) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, x in enumerate(t["text__"]):
            raw = x.as_py()
            n = len(raw or b"")
            spans = spans_of(i, n)
            kept = _without(raw or b"", spans)
            new = None if digest_only or raw is None else _without(raw, _whole_characters(raw, spans)).decode("utf-8", "replace")
            for col, v in zip(out, (new, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                col.append(v)
        numbers = [pa.array(x, pa.int64()) for x in out[1:4]] + [pa.array(out[4], pa.string())]
        if digest_only:
            return pa.Table.from_arrays([t["doc_id__"], *numbers], schema=target)
        cols = [*(t[f"c{i}"] for i in range(len(others))), pa.array(out[0], pa.string()), *numbers]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not rows.num_rows:
            return to_arrow_schema(schema).empty_table()
        t, ids, _, own, copied, gone = _read(rows, told, buckets)
        ranges: dict[int, list[tuple[int, int]]] = {}
        lens = [len(x) - LENGTH + 1 for x in own.number]
        for i, s, end, no, period in own.where:
            for off, m in [(0, lens[no])] if ids[i] > own.least[no] else gone.get(no, ()):
                ranges.setdefault(i, []).extend(own.spread(s, end, period, off, m))
        del own
        done = results(t, lambda i, n: ([(0, n)] if n >= LENGTH else []) if copied[i] else _spans(ranges.get(i, [])))
        del ranges
        release()
        return done

    def untouched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from results(pa.Table.from_batches([b]), lambda i, n: []).to_batches()

    right = told.unionByName(gone)
    done = packed.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(finish, schema).unionByName(carried.where("doc_id__ is null").mapInArrow(untouched, schema))
    if digest_only:
        return done
    names = {c: f"c{i}" for i, c in enumerate(others)} | {text_col: "text__"}
    return done.select(*(F.col(names[c]).alias(c) for c in docs.columns if c in names), *(f.name for f in added))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True)


#: Bytes are two hex digits here, as strings of bytes can be cut and joined so.
OP5_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
     w as (select doc_id, p, substring(hx, 2 * p + 1, 100) as s from (select doc_id, hx, unnest(range(0, length(hx) // 2 - 49)) as p from d)),
     f as (select s, min(doc_id) as first_id from w group by s),
     g as (select doc_id, p, lag(p) over (partition by doc_id order by p) as prev from (select w.doc_id, w.p from w join f using (s) where f.first_id < w.doc_id)),
     r as (select doc_id, min(p) as a, max(p) + 50 as b from (select *, sum(case when prev is null or p > prev + 50 then 1 else 0 end) over (partition by doc_id order by p) as k from g) group by doc_id, k),
     seg as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as s0, a as s1 from r
             union all select d.doc_id, coalesce(max(b), 0), any_value(length(hx)) // 2 from d left join r using (doc_id) group by d.doc_id),
     k as (select doc_id, string_agg(substring(hx, 2 * s0 + 1, 2 * (s1 - s0)), '' order by s0) as kept from seg join d using (doc_id) group by doc_id),
     n as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans from r group by doc_id)
select d.doc_id, (length(hx) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept)) as kept_sha256
from d join k using (doc_id) left join n using (doc_id)
"""
