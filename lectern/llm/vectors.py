"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Principal axes and rotations for balanced binary codes are learned on a bounded sample (iterative quantisation: signs and
rotation are fitted to each other in turns). A vector's bits are dealt to tables of `bits` bits each; vectors that share a table's
bits meet in a bucket. Three steps follow.

1. Buckets hold a code of `CODE` bits and a number for each vector, some 30 bytes. Codes are compared in tiles by Hamming distance;
   within a radius that is measured to hold all but a few in a thousand of the pairs at the threshold, vectors are candidates.
2. Only candidates' vectors follow them, and are reranked by cosine in double precision.
3. Links are counted and joined to components. Equal vectors are one vertex with a weight.

Centring widens angles, so how often pairs at the threshold agree is measured on the sample's own pairs and on pairs made from
it. `bits` is what makes messages and comparisons cheapest, and tables are added until the share `recall` of pairs at the threshold is
measured to meet, for each kind of pair; closer pairs meet more often. With a recall of 1, for lengths of at most `FEW` vectors, or
where nothing else reaches `recall`, all vectors of a length are compared, dealt as pairs of parts: the exact way.

A pair counts in the first table in which it meets, so links are summed without gathering pairs; for components a bucket
returns spanning links only. Buckets are grouped to some thousand rows a task, and groups above a limit of rows or
bytes are dealt as pairs of parts.

Cases: null, zero, and partly null or non-finite vectors link with nothing; vectors of different lengths have no cosine and do
not link, each length is compared by itself; rows with equal ids are separate rows; a row without an id links like any other, and
its component's id is that of the others, null if none has one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import column, cut, table
from .components import components, forest

THRESHOLD = 0.9
#: Vectors of a sample, those of them that rotations are fitted to, and rounds of fitting.
SAMPLE, FIT, ROUNDS, SEED = 20_000, 8000, 25, 7
#: Principal axes that a rotation turns, the widest of a vector's.
AXES = 256
#: Share of pairs at the threshold that must meet; share of them that the codes' radius may lose.
RECALL, RADIUS_LOSS = 0.985, 0.002
#: Bits of the codes that are compared; bytes of a row with one; what comparing two codes costs in bytes moved.
CODE, CODE_BYTES, COMPARISON = 64, 28, 0.05
#: Vectors of one length that are all compared with each other.
FEW = 2048
#: Pairs of each kind that recall is measured on, and how far above the threshold the sample's own pairs may lie.
PAIRS, NEAR = 4000, 0.01
#: Rows that a task's group of buckets is planned for, rows and bytes of vectors above which it is split, rows compared at once.
GROUP_ROWS, SPLIT_ROWS, SPLIT_BYTES, TILE = 4096, 16384, 64 << 20, 1024


def _rotations(x: np.ndarray, rounds: int, seed: int) -> Iterator[np.ndarray]:
    """Projections from centred vectors, each a learned rotation of their principal axes."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, -AXES:]
    rng = np.random.default_rng(seed)
    v = x[rng.permutation(len(x))[:FIT]] @ axes
    while True:
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            signs = np.where(v @ r > 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(v.T @ signs)
            r = a @ b
        yield axes @ r


def learn(x: np.ndarray, n_bits: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x n_bits at least) from unit vectors: as many learned rotations as the bits need."""
    mean = x.mean(0)
    return mean, np.concatenate(list(islice(_rotations(x - mean, rounds, seed), max(1, -(-n_bits // x.shape[1])))), 1)


def pairs_at(x: np.ndarray, threshold: float, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs of unit vectors at the threshold: turned anywhere, turned along the sample's differences, and the sample's own."""
    rng = np.random.default_rng(seed)
    left, j, k = (rng.integers(0, len(x), PAIRS) for _ in range(3))
    out = []
    for u in (rng.standard_normal((PAIRS, x.shape[1])), x[j] - x[k]):
        u = u - (u * x[left]).sum(1, keepdims=True) * x[left]
        norm = np.linalg.norm(u, axis=1)
        some = norm > 1e-6
        if some.sum() >= PAIRS // 20:
            out.append((x[left[some]], threshold * x[left[some]] + math.sqrt(1 - threshold**2) * u[some] / norm[some, None]))
    base = rng.permutation(len(x))[:PAIRS]
    found = []
    for at in range(0, len(base), TILE):
        cosine = x[base[at : at + TILE]] @ x.T
        i, k = np.nonzero((cosine >= threshold) & (cosine < min(threshold + NEAR, 1 - 1e-9)))
        found.append(np.stack([base[i + at], k]))
    i, k = np.concatenate(found, 1)
    if len(i) >= PAIRS // 20:
        some = rng.permutation(len(i))[:PAIRS]
        out.append((x[i[some]], x[k[some]]))
    return out


def plan(x: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Mean, projection, bits of a table, number of tables and radius of the codes, for n vectors of which x is a sample of unit
    vectors. 0 bits: all are to be compared."""
    mean = x.mean(0)
    kinds = pairs_at(x, threshold)
    more = _rotations(x - mean, ROUNDS, SEED)
    project = next(more)
    while project.shape[1] < CODE:
        project = np.concatenate([project, next(more)], 1)
    same = lambda l, r: ((l - mean) @ project > 0) == ((r - mean) @ project > 0)
    agree = [same(l, r) for l, r in kinds]
    rng = np.random.default_rng(SEED)
    apart = same(*(x[rng.integers(0, len(x), 5 * PAIRS)] for _ in range(2))).mean(1)
    radius = max((int(np.ceil(np.quantile((~a[:, :CODE]).sum(1), 1 - RADIUS_LOSS))) for a in agree), default=CODE)

    def tables(bits: int) -> float:
        meet = min((float(np.mean(a.mean(1) ** bits)) for a in agree), default=1.0)
        return 1 if meet >= recall else math.log(1 - recall) / math.log1p(-max(meet, 1e-9))

    def cost(bits: int) -> float:
        """Bytes of a vector's messages, and comparisons in bytes."""
        return tables(bits) * (CODE_BYTES + COMPARISON * n * float(np.mean(apart**bits)))

    bits = min(range(31), key=cost) if recall < 1 and radius < CODE else 0
    while bits:
        near = [(~a[:, :CODE]).sum(1) <= radius for a in agree]
        met = [np.zeros(len(a), np.bool_) for a in agree]
        for t in range(2 * math.ceil(tables(bits)) + 8):
            while project.shape[1] < (t + 1) * bits:
                project = np.concatenate([project, next(more)], 1)
                agree = [np.concatenate([a, ((l - mean) @ project[:, a.shape[1] :] > 0) == ((r - mean) @ project[:, a.shape[1] :] > 0)], 1) for a, (l, r) in zip(agree, kinds, strict=True)]
            for m, a, w in zip(met, agree, near, strict=True):
                m |= a[:, t * bits : (t + 1) * bits].all(1) & w
            if all(m.mean() >= recall for m in met):
                return mean, project[:, : max(CODE, (t + 1) * bits)], bits, t + 1, radius
        bits -= 1
    return mean, project[:, :0], 0, 1, CODE


def _units(raw: Iterable, dtype: np.dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, np.dtype]:
    """vec_id and the vector's bytes, null where it links with nothing."""
    kind = dict(vectors.dtypes)[vector_col]
    dtype = np.dtype("<f4") if kind == "array<float>" else np.dtype("<f8")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for x in b.column(1):
                v = None
                if x.is_valid and not x.values.null_count and len(x.values):
                    a = x.values.to_numpy(zero_copy_only=False)
                    v = a.astype(dtype).tobytes() if np.isfinite(a).all() and a.any() else None
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    wide = column(vectors, vector_col).cast("array<float>" if dtype.itemsize == 4 else "array<double>")
    return vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), wide.alias("v")).mapInArrow(run, "vec_id long, raw binary"), dtype


def link_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept (vec_id = component_id).

    `recall` is the share of pairs at the threshold that must be found; 1 compares all pairs.
    """
    spark = vectors.sparkSession
    raws, dtype = _bytes_of(vectors, id_col, vector_col)
    rows = cut(raws.withColumn("digest", F.substring(F.unhex(F.sha2("raw", 256)), 1, 16)))
    distinct = rows.where("raw is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    distinct = cut(distinct.withColumns({"v": F.monotonically_increasing_id(), "width": F.octet_length("raw")}))
    links, compared = [], []
    for width, n in sorted(tuple(r) for r in distinct.groupBy("width").agg(F.count("*")).collect()):  # a row for each length
        found = None
        if n > FEW and recall < 1:
            own = distinct.where(F.col("width") == width)
            share = int(min(1.0, SAMPLE / n) * (1 << 30))
            picked = own.where(F.pmod(F.xxhash64("raw"), F.lit(1 << 30)) < share).select("raw").collect()  # about SAMPLE rows
            planned = plan(_units(sorted(bytes(r["raw"]) for r in picked), dtype), n, threshold, recall)
            if planned[2]:
                found = cut(_indexed(own, n, spark.sparkContext.broadcast(planned[:2]), *planned[2:], dtype, threshold))  # dimension x some hundred numbers
        if found is None:
            compared.append(width)
        else:
            links.append(found)
    if compared:
        every = distinct.where(F.col("width").isin(compared)).select(F.col("width").alias("table"), F.lit(0).alias("low"), F.lit(0).alias("key"), "v", "weight", "raw")
        links.append(cut(_exact(every, None, 0, CODE, dtype, threshold, max(compared))))
    found = spark.createDataFrame([], "a long, b long, n long")
    for x in links:
        found = found.unionByName(x)
    counts = found.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("vertex", "v")
    known = distinct.select("digest", "v", "rep", "weight").join(counts, "v", "left").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "root").select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "digest").join(known, "digest", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _in_parts(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """`rows` (table, low, v, ...) with p, q, part: those of a group above the limit (`sizes` has each group's n) go to every
    pair of parts that theirs is in."""
    hot = sizes.groupBy("table", "low").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("table", "low", F.ceil(F.col("n") / (limit / 2)).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"), F.lit(0))
    dealt = rows.join(hot, ["table", "low"], "left").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other", "parts")


def _tiles(key: np.ndarray, part: np.ndarray, near: Callable[[slice, slice], np.ndarray], whole: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For rows sorted by key: near pairs of equal keys (of different parts unless whole), as (bucket's start, end, rows, rows)."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)).tolist()
    at = 0
    for end in ends:
        if end - at > 1:
            for i in range(at, end, TILE):
                for j in range(i, end, TILE):
                    left, right = slice(i, min(i + TILE, end)), slice(j, min(j + TILE, end))
                    found = near(left, right)
                    if i == j:
                        found = np.triu(found, 1)
                    if not whole:
                        found &= part[left, None] != part[None, right]
                    a, b = np.nonzero(found)
                    if len(a):
                        yield at, end, a + i, b + j
        at = end


def _code(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits[:, :CODE], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _indexed(distinct: DataFrame, n: int, learned, bits: int, n_tables: int, radius: int, dtype: np.dtype, threshold: float) -> DataFrame:
    """Rows (a, null, n): vertex a has links to vertices of weight n; rows (a, b, 0): spanning links. By tables of codes."""
    shift = bits
    while shift and n >> (bits - shift) > GROUP_ROWS:
        shift -= 1

    def coded(raw: Iterable) -> tuple[np.ndarray, np.ndarray]:
        mean, project = learned.value
        on = (_units([v.as_buffer().to_pybytes() for v in raw], dtype) - mean) @ project > 0
        return _code(on), (on[:, : n_tables * bits].reshape(len(on), n_tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, keys = coded(b.column(1))
                for t in range(n_tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t), pa.int32()), pa.array(keys[:, t] >> shift, pa.int32()), pa.array(keys[:, t]), b.column(0), pa.array(code.view(np.int64))], names=["table", "low", "key", "v", "code"])

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                group, count = np.unique((coded(b.column(0))[1] >> shift) + (np.arange(n_tables) << (bits - shift)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(group >> (bits - shift), pa.int32()), pa.array(group & ((1 << (bits - shift)) - 1), pa.int32()), pa.array(count, pa.int64())], names=["table", "low", "n"])

    def candidates(t: pa.Table) -> pa.Table:
        key, v, part, code = (t[c].to_numpy() for c in ("key", "v", "part", "code"))
        order = np.argsort(key, kind="stable")
        key, v, part, code = key[order], v[order], part[order], code[order].view(np.uint64)
        some = np.zeros(len(v), np.bool_)
        near = lambda i, j: np.bitwise_count(code[i, None] ^ code[None, j]) <= radius
        for _, _, a, b in _tiles(key, part, near, t["p"][0].as_py() == t["q"][0].as_py()):
            some[a] = some[b] = True
        k = int(some.sum())
        return pa.table({"table": pa.repeat(t["table"][0], k), "low": pa.repeat(t["low"][0], k), "key": pa.array(key[some]), "v": pa.array(v[some])})

    codes = distinct.select("v", "raw").mapInArrow(encode, "table int, low int, key int, v long, code long")
    dealt = _in_parts(codes, distinct.select("raw").mapInArrow(sizes, "table int, low int, n long"), SPLIT_ROWS)
    met = cut(dealt.groupBy("table", "low", "p", "q").applyInArrow(candidates, "table int, low int, key int, v long").distinct())
    return _exact(met.join(distinct.select("v", "weight", "raw"), "v"), learned, bits, radius, dtype, threshold, distinct.select(F.max("width")).first()[0])


def _exact(rows: DataFrame, learned, bits: int, radius: int, dtype: np.dtype, threshold: float, width: int) -> DataFrame:
    """Links among `rows` (table, low, key, v, weight, raw) of equal table and key, by their vectors; `width`: bytes of a vector."""
    limit = max(64, min(SPLIT_ROWS, SPLIT_BYTES * dtype.itemsize // (8 * width)))
    dealt = _in_parts(rows, rows.groupBy("table", "low").agg(F.count("*").alias("n")), limit).select("table", "low", "p", "q", "part", "key", "v", "weight", "raw")

    def compare(t: pa.Table) -> pa.Table:
        now = t["table"][0].as_py()
        v, weight, part, key = (t[c].to_numpy() for c in ("v", "weight", "part", "key"))
        x = _units(t["raw"].to_pylist(), dtype)
        order = np.lexsort((v, key))
        v, weight, part, key, x = v[order], weight[order], part[order], key[order], x[order]
        if bits:
            mean, project = learned.value
            on = (x - mean) @ project > 0
            code, earlier = _code(on), on[:, : now * bits].reshape(len(on), now, bits)
        total = np.zeros(len(v), np.int64)
        label = np.arange(len(v))
        for at, end, a, b in _tiles(key, part, lambda i, j: x[i] @ x[j].T >= threshold, t["p"][0].as_py() == t["q"][0].as_py()):
            if bits:
                inside = np.bitwise_count(code[a] ^ code[b]) <= radius
                a, b = a[inside], b[inside]
                # A pair counts in the first table that it meets in.
                fresh = np.concatenate([~(earlier[a[i : i + TILE]] == earlier[b[i : i + TILE]]).all(2).any(1) for i in range(0, len(a), TILE)] or [np.zeros(0, np.bool_)])
            else:
                fresh = np.ones(len(a), np.bool_)
            np.add.at(total, a[fresh], weight[b[fresh]])
            np.add.at(total, b[fresh], weight[a[fresh]])
            label[at:end] = at + forest(end - at, np.concatenate([np.arange(end - at), a - at]), np.concatenate([label[at:end] - at, b - at]))
        some, linked = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(label)))
        ends = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v[label[linked]], pa.int64())])
        return pa.table({"a": pa.array(np.concatenate([v[some], v[linked]]), pa.int64()), "b": ends, "n": pa.array(np.concatenate([total[some], np.zeros(len(linked), np.int64)]), pa.int64())})

    return dealt.groupBy("table", "low", "p", "q").applyInArrow(compare, "a long, b long, n long")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
                     where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0),
     l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
     r as (select vec_id, vec_id as reach from embeddings union select r.vec_id, l.b from r join l on r.reach = l.a),
     c as (select vec_id, min(reach) as component_id from r group by vec_id),
     n as (select a as vec_id, count(*)::bigint as n_links from l group by a)
select c.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)
"""
