"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language's raw-content zstandard dictionary is cut from a bounded sample of its labelled rows. A text in lower case is
compressed in blocks with every dictionary (all blocks, so whole texts count), and the smallest total wins. Where the runner-up is
closer than `MARGIN` the verdict is marked as rejected; the nearest language is still named.

The sample is the rows whose hash is below a language's share, about `SAMPLE_ROWS` for each language, each giving at most `EXCERPT`
bytes, up to `DICTIONARY` bytes; where languages are so many that these would exceed `DICTIONARIES` bytes in all, each gets an
equal share of those. It is the only bounded part, as a fit on labelled rows may be; every language is learned.

Cases: a null text, or one without a letter, is `und` with score 0; rows without a language or with a held-out hash are not
learned from; equal sizes go to the first language by name; if nothing can be learned every row is `und`; repeated doc_ids
are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import column, released, table

UNDETERMINED = "und"
#: Bounds of what is learned from, for each language.
SAMPLE_ROWS, EXCERPT, DICTIONARY = 400, 1024, 96 << 10
#: Bytes of all dictionaries; values that hashes are taken to; languages whose shares are broadcast (some 40 bytes each).
DICTIONARIES, _SPACE, BROADCAST_ROWS = 48 << 20, 1 << 30, 100_000
#: Bytes of a block; smaller blocks lean more on the dictionary.
BLOCK = 2048
#: A lead over the runner-up, as a share of its size, below which a verdict is rejected.
MARGIN = 0.02
#: The lazy binary-tree search finds the short matches that tell languages apart; faster levels miss many of them.
SEARCH = {"strategy": zstandard.STRATEGY_BTLAZY2, "min_match": 4, "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 4, "target_length": 32}


def held_out(doc_id: Column) -> Column:
    """The rows that nothing may be learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A dictionary's bytes for each language of the rows that are not held out."""
    doc_id, lang, text = column(docs, id_col), column(docs, lang_col), column(docs, text_col)
    known = docs.where(~held_out(doc_id) & lang.isNotNull() & (lang != UNDETERMINED) & text.isNotNull())
    counts = known.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return {}
    size = min(DICTIONARY, DICTIONARIES // len(counts))
    sample_rows = max(4, min(sample_rows, 4 * size // EXCERPT))
    # A row is taken if its hash is below the language's share: no language's rows meet in one task.
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(_SPACE, _SPACE * sample_rows // r["n"])) for r in counts], "lang string, below long")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(_SPACE))
    rows = known.select(doc_id.alias("id"), lang.alias("lang"), text.alias("text")).join(F.broadcast(limits) if len(counts) <= BROADCAST_ROWS else limits, "lang").where(place < F.col("below"))
    rows = rows.select("lang", place.alias("h"), F.substring("text", 1, EXCERPT).alias("text")).distinct().collect()  # about sample_rows for each language; equal rows once
    found: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"].lower().encode("utf-8", "ignore")[:EXCERPT])
    # Equal excerpts once; zstandard finds what stands last at the shortest distance.
    joined = {k: b"\n".join(dict.fromkeys(v))[:size] for k, v in found.items()}
    return {k: joined[k] for k in sorted(joined) if len(joined[k]) >= 8}


class Identifier:
    """Compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.compressors = []
        for k in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            rules = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **SEARCH)
            d.precompute_compress(compression_params=rules)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=rules, dict_data=d).compress)

    def sizes(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(map(len, map(c, blocks))) for c in self.compressors]

    def verdict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, margin, whether it is rejected."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(text.lower().encode("utf-8", "replace"))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        margin = 1 - sizes[best] / min(rest) if rest else 1.0
        return self.names[best], min(1.0, margin / (margin + MARGIN)), margin, margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARIES bytes at most
    held: list[Identifier] = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Identifier(shared.value))
        for b in batches:
            got = [held[0].verdict(x.as_py()) for x in b.column(2)]
            cols = [pa.array([x[k] for x in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    doc_id = column(docs, id_col)
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
