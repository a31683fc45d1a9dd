"""SimHash near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of `SIMILARITY` or more.

The radius that covers such a similarity is too wide for buckets by blocks of bits, so this form of the operator works in
three steps.

1. A text's distinct shingle hashes give a SimHash of `BITS` bits and `BANDS` keys, each made of the least hashes under `DEPTH`
   orders. Texts of similarity 0.8 share a key with probability 0.998, whatever the number of rows; closer ones more often.
2. Texts with a key in common are compared in tiles by exclusive-or and bit counts; within `RADIUS` bits they are candidates.
   Shingle sets of similarity 0.8 have a cosine of 0.889 at least, and differ in some 39 of 256 bits (deviation 6).
3. Components of candidates are compared exactly, by products of their shingles' incidence matrices in tiles. Only
   verified links count.

Texts of equal shingle sets are one vertex. Tasks return spanning links, never pairs, and skip tiles whose rows are all linked
already. Rows of a key that more than `SPLIT_ROWS` rows have are candidates without step 2, by one grouped minimum. A candidate
component of more than `GROUP_BYTES` is dealt to parts: each compares its rows with some `LEADERS` rows of the component, picked by
hash; rows that these leave outside the largest group found are then compared with all rows of the component, part by part. So a
large family of near copies costs in proportion to its size, and only what does not link to it costs more.

Cases: words are those of `simhash`; a text with fewer words than a shingle has one shingle, the whole sequence; null and blank
texts have none and equal each other; repeated ids are separate rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, cut, released, row_key
from .components import components, forest
from .simhash import SEED, word_blocks

WIDTH, SIMILARITY = 5, 0.8
BITS, RADIUS = 256, 72
BANDS, DEPTH = 16, 5
#: Rows of a task's group of keys, rows above which a key is split, rows of a tile.
GROUP_ROWS, SPLIT_ROWS, TILE = 16384, 16384, 512
#: Bytes of shingle hashes that a task compares; columns of an incidence matrix at a time.
GROUP_BYTES, COLUMNS = 8 << 20, 8192
#: Rows of a large component that all its rows are compared with first; tasks in which a hot key's rows are looked up.
LEADERS, SALTS = 32, 16

_rng = np.random.default_rng(SEED)
#: Odd multipliers: of the orders that keys are taken from, and of the words of a fingerprint.
_ORDERS = _rng.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = _rng.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    found: list[np.ndarray] = []
    carry: list[bytes] = []
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)))
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if found:
        return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    return np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)] if carry else [], np.uint64)


def sketch(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The SimHash (BITS // 8 bytes) and the band keys of a set of hashes."""
    ones, least = np.zeros(BITS, np.int64), np.full(len(_ORDERS), np.iinfo(np.uint64).max)
    for i in range(0, len(h), 1024):
        part = h[i : i + 1024]
        mixed = part[:, None] * _WORDS
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        np.minimum(least, (part * _ORDERS[:, None]).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(DEPTH):
        keys = (keys ^ least[k::DEPTH]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes(), keys.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, row (a key of id and text), n (shingles), digest of the shingle set, fp, keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, fps, keys = [], [], [], []
            for x in b.column(2):
                h = shingle_set(x.as_py(), width)
                fp, key = sketch(h)
                for col, v in zip((n, digests, fps, keys), (len(h), xxhash.xxh3_128_digest(h.tobytes()), fp, key.tobytes()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, fps, keys))], names=["id", "row", "n", "digest", "fp", "keys"])

    kind = dict(docs.dtypes)[id_col]
    return _rows(docs, id_col, text_col).mapInArrow(released(run), f"id {kind}, row binary, n long, digest binary, fp binary, keys binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(docs, id_col).alias("id"), row_key(docs, id_col, text_col).alias("row"), column(docs, text_col).alias("text"))


class _Links:
    """Spanning links among n rows."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def settled(self, i: int, j: int, a: int, b: int) -> bool:
        """Whether rows i..a and j..b are all linked already."""
        first = self.label[i]
        return bool((self.label[i:a] == first).all() and (self.label[j:b] == first).all())

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            n = len(self.label)
            self.label = forest(n, np.concatenate([np.arange(n), a]), np.concatenate([self.label, b]))

    def table(self, names: np.ndarray) -> pa.Table:
        some = np.flatnonzero(self.label != np.arange(len(self.label)))
        return pa.table({"a": pa.array(names[some]), "b": pa.array(names[self.label[some]])})


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16) <= RADIUS


def _candidates(t: pa.Table) -> pa.Table:
    """Links among rows that share a key and lie within the radius."""
    names, row = np.unique(t["v"].to_numpy(), return_inverse=True)
    key = t["key"].to_numpy()
    fps = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
    pops = np.bitwise_count(fps).sum(1, dtype=np.int16)
    order = np.lexsort((pops, key))
    row, key, fps, pops = row[order], key[order], fps[order], pops[order]
    links = _Links(len(names))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(starts, len(key)))
    for s, n in zip(starts[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        own = _Links(n)
        for i in range(s, s + n, TILE):
            a = min(i + TILE, s + n)
            for j in range(i, s + n, TILE):
                b = min(j + TILE, s + n)
                if int(pops[j]) - int(pops[a - 1]) > RADIUS:
                    break
                if own.settled(i - s, j - s, a - s, b - s):
                    continue
                near = _near(fps[i:a, None], fps[None, j:b])
                x, y = np.nonzero(np.triu(near, 1) if i == j else near)
                own.add(x + i - s, y + j - s)
        links.add(row[s : s + n], row[s + own.label])
    small = np.repeat(size <= 64, size)
    row, key, fps = row[small], key[small], fps[small]
    for d in range(1, 64):  # in small buckets: each row with the d-th after it
        at = np.flatnonzero(key[:-d] == key[d:])
        if not len(at):
            break
        at = at[row[at] != row[at + d]]
        at = at[_near(fps[at], fps[at + d])]
        links.add(row[at], row[at + d])
    return links.table(names)


def _shared_counts(term: np.ndarray, row: np.ndarray, left: int, right: int, n_left: int, n_right: int) -> np.ndarray:
    """How many terms each of the rows from `left` shares with each of those from `right`; term and row are sorted by term."""
    out = np.zeros((n_left, n_right), np.float32)
    for k in range(0, int(term[-1]) + 1, COLUMNS) if len(term) else ():
        i, j = np.searchsorted(term, (k, k + COLUMNS))
        r, c = row[i:j], term[i:j] - k
        sides = []
        for at, n in ((left, n_left), (right, n_right)):
            some = (r >= at) & (r < at + n)
            x = np.zeros((n, COLUMNS), np.float32)
            x[r[some] - at, c[some]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def exact_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Labels of what links of `similarity` or more connect among the sets: those of one side with each other and, where two
    sides are given, only those of one with those of the other."""
    n = len(sets)
    links = _Links(n)
    size = np.array([len(x) for x in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if both and both >= similarity * (size.sum() - both) - 1e-9:
            links.add(np.array([0]), np.array([1]))
        return links.label
    order = np.lexsort((size, side))
    size, side = size[order], side[order]
    two = bool(side[0] != side[-1])
    row = np.repeat(np.arange(n), size)
    values = np.concatenate([sets[i] for i in order.tolist()])
    by = np.argsort(values, kind="stable")
    values, row = values[by], row[by]
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    last = np.append(new[1:], True)[: len(values)]
    shared = ~(new & last)
    term = np.cumsum(new[shared]) - 1
    row = row[shared]
    for i in range(0, n, TILE):
        a = min(i + TILE, n)
        for j in range(i, n, TILE):
            b = min(j + TILE, n)
            if two and side[i] == side[b - 1] or links.settled(i, j, a, b):
                continue
            # Sizes apart by more than the similarity cannot link.
            if size[i:a].max() < similarity * size[j:b].min() - 1e-9 or size[j:b].max() < similarity * size[i:a].min() - 1e-9:
                continue
            inside = ((row >= i) & (row < a)) | ((row >= j) & (row < b))
            t, r = term[inside], row[inside]
            t = np.cumsum(np.append(0, t[1:] != t[:-1])) if len(t) else t  # terms of these tiles only
            both = _shared_counts(t, r, i, j, a - i, b - j)
            near = (both >= similarity * (size[i:a, None] + size[None, j:b] - both) - 1e-3) & (both > 0)
            if i == j:
                near = np.triu(near, 1)
            if two:
                near &= side[i:a, None] != side[None, j:b]
            x, y = np.nonzero(near)
            links.add(x + i, y + j)
    label = np.arange(n)
    label[order] = order[links.label]
    return label


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """id and group (a number; null for rows without words) of every row: rows of one group are connected by links of
    `similarity` or more."""
    rows = cut(_sketches(docs, id_col, text_col, width))
    distinct = rows.groupBy("digest").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("row").alias("row"), F.first("n").alias("n"))
    distinct = cut(distinct.where("n > 0").withColumn("v", F.monotonically_increasing_id()))

    def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, BANDS)
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]), b.column(0), b.column(1)], names=["key", "v", "fp"])

    met = distinct.select("v", "fp", "keys").mapInArrow(released(banded), "key long, v long, fp binary")
    n_groups = max(1, BANDS * distinct.count() // GROUP_ROWS)
    hot = met.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("b")).where(F.col("n") > SPLIT_ROWS).select("key", "b")
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = met.withColumn("salt", salt).join(salted, ["key", "salt"], "left")
    near = dealt.where("b is null").select(F.pmod("key", F.lit(n_groups)).alias("bucket"), "key", "v", "fp").groupBy("bucket").applyInArrow(_candidates, "a long, b long")
    candidates = cut(components(near.unionByName(dealt.where("b is not null").select(F.col("v").alias("a"), "b"))).withColumnsRenamed({"vertex": "v", "root": "candidate"}))

    # The texts of candidates only: one for each shingle set.
    chosen = cut(distinct.join(candidates, "v").select("row", "digest", "v", "candidate", "n"))
    sizes = cut(chosen.groupBy("candidate").agg((8 * F.sum("n") + 64 * F.count("*")).alias("size"), F.count("*").alias("rows")))
    total, largest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    n_groups = max(1, int(total) // GROUP_BYTES)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for b in batches:
            rows, sets = [], []
            for i, (x, digest) in enumerate(zip(b.column(0), b.column(1).to_pylist(), strict=True)):
                if digest not in done:
                    raw = shingle_set(x.as_py(), width).tobytes()
                    done.add(digest)  # equal rows have one key
                    rows.append(i)
                    sets.append(raw)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2).take(at), b.column(3).take(at), pa.array(sets, pa.binary())], names=["v", "candidate", "hashes"])

    def hashes_of(some: DataFrame) -> DataFrame:
        """v, candidate, hashes of chosen rows."""
        texts = _rows(docs, id_col, text_col).join(some.select("row", "digest", "v", "candidate"), "row")
        return texts.select("text", "digest", "v", "candidate").mapInArrow(released(hashed), "v long, candidate long, hashes binary")

    def linked(t: pa.Table) -> pa.Table:
        t = t.sort_by([("candidate", "ascending"), ("v", "ascending"), ("side", "ascending")])
        names, group, side = t["v"].to_numpy(), t["candidate"].to_numpy(), t["side"].to_numpy()
        again = np.append(False, (names[1:] == names[:-1]) & (group[1:] == group[:-1]) & (side[1:] == side[:-1]))  # tasks may each have sent a copy's set
        at = np.flatnonzero(~again)
        names, group, side = names[at], group[at], side[at]
        sets = [np.frombuffer(t["hashes"][i].as_buffer(), np.uint64) for i in at.tolist()]
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        label = np.concatenate([i + exact_links(sets[i:j], side[i:j], similarity) for i, j in zip(edges, edges[1:])])
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(names[some]), "b": pa.array(names[label[some]])})

    def within(rows: DataFrame) -> DataFrame:
        """Links among rows of one candidate component, some components to a task."""
        dealt = rows.select(F.pmod(F.xxhash64("candidate"), F.lit(n_groups)).alias("bucket"), "candidate", "v", F.lit(0).alias("side"), "hashes")
        return dealt.groupBy("bucket").applyInArrow(linked, "a long, b long")

    def between(left: DataFrame, right: DataFrame) -> DataFrame:
        """Links between left and right rows (candidate, p, q, v, hashes) of equal candidate, p and q."""
        both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
        return both.groupBy("candidate", "p", "q").applyInArrow(linked, "a long, b long")

    hot = sizes.where(F.col("size") > GROUP_BYTES).select("candidate", "rows", F.ceil(F.col("size") / (GROUP_BYTES / 2)).cast("int").alias("parts"))
    if largest <= GROUP_BYTES:
        links = within(hashes_of(chosen))
    else:
        links = within(hashes_of(chosen.join(hot, "candidate", "left_anti")))
        links = links.unionByName(_large(cut(hashes_of(chosen.join(hot, "candidate", "left_semi")).join(hot, "candidate")), between))
    roots = cut(components(links).withColumnRenamed("vertex", "v"))
    known = distinct.select("digest", "v").join(roots, "v", "left").select("digest", F.coalesce("root", "v").alias("group"))
    return rows.select("id", "digest").join(known, "digest", "left").select("id", "group")


def _large(rows: DataFrame, between: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Links within candidate components that are too large for a task: rows have candidate, rows (of it), parts, v, hashes."""
    place = lambda parts: F.pmod(F.xxhash64("v"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = rows.withColumn("q", place("parts"))
    leaders = own.where(F.pmod(F.xxhash64("v", F.lit("leader")), F.lit(1 << 30)) < F.lit(LEADERS << 30) / F.col("rows"))
    columns = ["candidate", "p", "q", "v", "hashes"]
    first = cut(between(leaders.drop("q").withColumns({"p": F.lit(0), "q": every("parts")}).select(columns), own.withColumn("p", F.lit(0)).select(columns)))
    labels = components(first).withColumnRenamed("vertex", "v")
    labelled = cut(own.select("candidate", "v", "parts", F.octet_length("hashes").alias("size")).join(labels, "v", "left").withColumn("root", F.coalesce("root", "v")))
    most = labelled.groupBy("candidate", "root").agg(F.count("*").alias("n")).groupBy("candidate").agg(F.max(F.struct("n", "root")).alias("most")).select("candidate", F.col("most.root").alias("main"))
    # Rows outside their component's largest group meet all rows of the component.
    outside = cut(labelled.join(most, "candidate").where("root != main").select("candidate", "v", "size"))
    some = outside.groupBy("candidate").agg(F.ceil((F.sum("size") + 64 * F.count("*")) / (GROUP_BYTES / 2)).cast("int").alias("others"))
    left = own.drop("q").join(outside.select("v"), "v", "left_semi").join(some, "candidate").withColumns({"p": place("others"), "q": every("parts")}).select(columns)
    right = own.join(some, "candidate").withColumn("p", every("others")).select(columns)
    return first.unionByName(between(left, right))
