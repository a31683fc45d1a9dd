"""Deterministic sharded WARC writer and its reader.

`write_archives` range-sorts records by id into shards of about equal bytes, streams each shard into files that are rolled when
their compressed size reaches a limit, regenerates every header and digest from the payload, writes under temporary names,
renames, and lists what is valid in manifests. `read_archives` reads only files that a manifest names, checks every length and
digest, and takes what it says of a revisit's payload from the response that the revisit refers to.

Shards' bounds are quantiles of the ids' bytes, over a sample of ids that are picked by hash, so the same table always gives
the same shards, and skewed ids spread. A file begins with a warcinfo record.

Cases: a null payload is an empty one; records without an id are dealt over all shards by digest, stand first there, and read
back as null; rows with the same id all get a record in one shard (ties go by payload digest, then url), which is streamed; an empty
table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import column, cut, new_path, table

#: Payloads shorter than this are never deduplicated.
MIN_REVISIT_BYTES = 100
#: A file is closed once its compressed size reaches this.
ROLL_BYTES = 16 << 20
#: Payload bytes that one shard is planned for.
SHARD_BYTES = 64 << 20
#: Shards at most (their bounds go to every task: 8 bytes each); ids that bounds are taken from, in each shard and in all.
MAX_SHARDS, SAMPLE_A_SHARD, SAMPLE = 100_000, 200, 200_000
#: Compressed bytes that a reader is fed at once.
FEED = 8 << 10
#: Tasks in which a response's revisits are looked up.
SALTS = 16
#: Records carry no clock of their own; a fixed date keeps files equal from run to run.
RECORD_DATE = "2024-01-01T00:00:00Z"

_RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target"]
_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _header(kind: str, rows: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in rows), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    """A record's name, made from what it holds so that a second run gives the same one; nth counts rows of one id and digest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{nth}')}>"


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c.isprintable() and not c.isspace())


def _member(raw: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write(raw)
    return out.getvalue()


def make_info(shard: int, part: int, date: str = RECORD_DATE) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    rows = [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo|{shard}|{part}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    return _member(_header("warcinfo", rows, block))


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int, date: str = RECORD_DATE) -> bytes:
    """One gzip member holding one WARC record, with all headers made anew."""
    digest = hashlib.sha256(payload).hexdigest()
    target = _clean(url)
    block_head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = block_head if refers_to is not None else block_head + payload
    rows = [
        ("WARC-Record-ID", record_id(page_id, digest, nth)),
        ("WARC-Date", date),
        *([("WARC-Target-URI", target)] if target else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
    ]
    if refers_to is not None:
        rows += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest, 0)),
            ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    return _member(_header("revisit" if refers_to is not None else "response", rows, block))


def _members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of a file, fed in small steps: what a member leaves of a step is copied."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        d = zlib.decompressobj(31)
        out = []
        while not d.eof and at < len(raw):
            fed = view[at : at + FEED]
            out.append(d.decompress(fed))
            at += len(fed) - len(d.unused_data)
        if not d.eof:
            raise ValueError("an archive ends within a record")
        yield b"".join(out)


def parse_record(raw: bytes) -> dict:
    """A record's headers (lower-case names) and block; raises where lengths or digests do not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]}")
    rows = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(rows["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its header")
    if rows["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a record's block does not fit its digest")
    if rows["warc-type"] == "response":
        rows["payload"] = payload = block.partition(b"\r\n\r\n")[2]
        if rows["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError("a record's payload does not fit its digest")
    return rows | {"block": block}


class _Rolling:
    """Files of one shard, written under temporary names and renamed when full."""

    def __init__(self, root: str, shard: int, attempt: str, roll: int, date: str) -> None:
        self.fs, self.root = _filesystem(root)
        self.shard, self.attempt, self.roll, self.date = shard, attempt, roll, date
        self.n, self.size, self.rows, self.out, self.done = 0, 0, 0, None, []

    def write(self, raw: bytes) -> None:
        if self.out is not None and self.size + len(raw) > self.roll:
            self.close()
        if self.out is None:
            self.temp = f"{self.root}/_temporary/{self.attempt}-{self.shard:08d}-{self.n:05d}"
            self.out, self.size, self.rows, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            self._put(make_info(self.shard, self.n, self.date))
        self._put(raw)
        self.rows += 1

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.size += len(raw)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        # Equal content under an equal name: a second attempt at this shard replaces a file by the same bytes.
        name = f"shard-{self.shard:08d}-{self.n:05d}-{self.sha.hexdigest()[:16]}.warc.gz"
        self.fs.move(self.temp, f"{self.root}/{name}")
        self.done.append((self.shard, self.n, name, self.size, self.rows))
        self.n += 1


def write_archives(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = RECORD_DATE) -> DataFrame:
    """Writes all `pages` below `root` and returns the manifest: shard, part, name, bytes, records.

    The number of shards follows from the payload bytes. A shard is streamed: memory holds one record, not the shard.
    """
    spark = pages.sparkSession
    rows = pages.select(
        column(pages, id_col).cast("long").alias("page_id"),
        column(pages, url_col).cast("string").alias("url"),
        F.coalesce(column(pages, payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    digests = cut(rows.select("page_id", F.octet_length("payload").cast("long").alias("n"), F.unhex(F.sha2("payload", 256)).alias("digest")))
    total, ids = digests.agg(F.coalesce(F.sum("n"), F.lit(0)) + 1024 * F.count("*"), F.count("page_id")).first()
    shards = min(MAX_SHARDS, max(1, -(-int(total) // shard_bytes)))
    # Ids are taken by hash with the bytes of all their rows, some SAMPLE of them at most by expectation.
    share = int(min(1.0, min(SAMPLE, SAMPLE_A_SHARD * shards) / max(ids, 1)) * (1 << 30))
    sizes = digests.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) <= share)).groupBy("page_id").agg((F.sum("n") + 1024 * F.count("*")).alias("n"))
    picked = sorted(tuple(r) for r in sizes.collect()) if shards > 1 else []
    ends = np.cumsum([n for _, n in picked])
    # A shard begins with the first id past its share of the sample's bytes.
    bounds = np.unique([picked[i][0] for i in np.minimum(np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards, side="right"), len(picked) - 1).tolist()]) if picked else np.empty(0, np.int64)
    in_order = F.pandas_udf(lambda x: pd.Series(np.searchsorted(bounds, x.to_numpy(np.int64), side="right")), "long")

    def shard(page_id: str, digest: Column) -> Column:
        return F.when(F.col(page_id).isNull(), F.pmod(F.xxhash64(digest), F.lit(len(bounds) + 1))).otherwise(in_order(F.coalesce(page_id, F.lit(0)))) if len(bounds) else F.lit(0).cast("long")

    first = digests.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    again = digests.where(F.col("n") >= min_revisit_bytes).join(first, "digest").select("page_id", "digest", "first_id").where("page_id is not null").distinct()
    # Notes on copies travel beside the pages and stand before them in each shard's order, so payloads move once.
    notes = again.select(shard("page_id", F.col("digest")).alias("shard"), "page_id", F.lit(0).alias("kind"), "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first_id")
    full = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).select(shard("page_id", F.col("digest")).alias("shard"), "page_id", F.lit(1).alias("kind"), "digest", "url", "payload", F.lit(None).cast("long").alias("first_id"))
    # A shard is a task: shard numbers are the partitions' own, so that no two shards meet by chance of a hash.
    both = full.unionByName(notes).repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "kind", "digest", "url")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        out: _Rolling | None = None
        at: object = ()
        done: list = []
        refs: dict[bytes, int] = {}
        last, nth = b"", 0
        for b in batches:
            for i in range(b.num_rows):
                s, pid, kind, digest, url, payload, first_id = (b.column(c)[i].as_py() for c in range(7))
                if out is None or s != out.shard:
                    if out is not None:
                        out.close()
                        done += out.done
                    out = _Rolling(root, s, attempt, roll_bytes, date)
                if at != (s, pid):
                    at, refs, last = (s, pid), {}, b""
                if kind == 0:
                    refs[digest] = first_id
                    continue
                last, nth = digest, nth + 1 if digest == last else 0  # rows of one digest follow each other
                ref = refs.get(digest)
                if ref is not None and ref == pid and nth == 0:
                    ref = None
                out.write(make_record(pid, url, payload, ref, nth, date))
        if out is not None:
            out.close()
            done += out.done
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "part", "name", "bytes", "records"])

    filesystem, path = _filesystem(root)
    filesystem.create_dir(f"{path}/_temporary", recursive=True)
    manifest = cut(both.mapInArrow(write, "shard long, part long, name string, bytes long, records long"))
    # The manifest is the commit: a reader takes only files that it names. It is written by its parts' tasks, then one marker.
    manifest.write.mode("overwrite").json(f"{root}/manifest")
    with filesystem.open_output_stream(f"{path}/_COMMITTED", compression=None) as f:
        f.write(json.dumps({"shards": len(bounds) + 1, "bounds": bounds.tolist()}).encode())
    filesystem.delete_dir(f"{path}/_temporary")
    return manifest


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """A row per record of the archives that the manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload_bytes are those of its response; a query over revisits without one fails.
    """
    listed = spark.read.schema("shard long, part long, name string, bytes long, records long").json(f"{root}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(root).select(F.substring_index("path", "/", -1).alias("name"), "content")
    named = files.join(listed.select("name", "records"), "name").select("content", "records")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found: list[tuple] = []
                for raw in _members(b.column(0)[i].as_buffer().to_pybytes()):
                    r = parse_record(raw)
                    if r["warc-type"] == "warcinfo":
                        continue
                    ids = [int(r[k]) if k in r else None for k in ("x-page-id", "x-refers-to-page-id")]
                    found.append((ids[0], None if r["warc-type"] == "revisit" else len(r["payload"]), r["warc-payload-digest"].removeprefix("sha256:"), r["warc-type"], ids[1], r["warc-record-id"], r.get("warc-refers-to")))
                if len(found) != b.column(1)[i].as_py():
                    raise ValueError("an archive has another number of records than its manifest says")
                types = (pa.int64(), pa.int64(), *[pa.string()] * 2, pa.int64(), *[pa.string()] * 2)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names=_RECORD)

    records = cut(named.mapInArrow(parse, _OUT + ", record_id string, target string"))
    # A response may have very many revisits, so these meet it in SALTS tasks.
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").withColumn("salt", salt)
    asked = revisits.select(F.col("target").alias("record_id")).distinct()
    responses = records.where("record_type = 'response'").join(asked, "record_id", "left_semi")
    targets = responses.select(F.col("record_id").alias("target"), "payload_bytes", F.col("payload_digest").alias("there"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    resolved = revisits.join(targets, ["target", "salt"], "left").withColumn("payload_bytes", F.when(F.col("there") == F.col("payload_digest"), F.col("payload_bytes")).otherwise(F.raise_error("a revisit refers to a response that is not there").cast("long")))
    columns = _RECORD[:5]
    return records.where("record_type != 'revisit'").select(columns).unionByName(resolved.select(columns))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), root)
    return read_archives(spark, root)


OP9_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
     d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
     f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first_id < d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id < d.page_id then f.first_id end as refers_to
from d left join f using (payload_digest)
"""
