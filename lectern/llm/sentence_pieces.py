"""SentencePiece models on the tokenizers library.

`parse_model` reads the protobuf by its wire format; `build` makes a tokenizer with the model's normaliser, the metaspace
marker, unigram scores (or, for BPE models, merges ordered by the scores of what they make) and byte fallback. Where no
piece of a model crosses between markers, line ends, letters and other characters but for leading markers, a text's ids are
those of its units one after the other; units not met before are encoded in multithreaded batches and kept. Other models
encode whole texts. `encode_documents` verifies parity with the sentencepiece library on every text.

Cases: a null or empty text has no ids; a literal marker in a text is encoded as a space is, so only then does decoding not
give the text back; repeated doc_ids are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from ._shared import column, release, released, table
from .word_tokens import BLOCK, TOGETHER, UnitCache, encode_units, in_blocks, split_ids

MARK = "▁"
#: Kinds of pieces and of models, as the protobuf numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A unit: markers with Latin letters or with other characters after them, markers alone, or a line end.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNIT = f"{MARK}*[{LETTERS}]+|{MARK}*[^{MARK}\n{LETTERS}]+|{MARK}+|\n"

#: Texts that the byte classes are right for: no null byte, no literal marker, letters of two bytes at most.
PLAIN = re.compile("[\x01-\x7fÀ-ÖØ-öø-ȿ]*")
_SPACE, _LETTER, _OTHER, _END = range(4)
_CLASS = np.full(256, _LETTER, np.uint8)
_CLASS[[x for x in range(128) if not chr(x).isalpha()]] = _OTHER
_CLASS[32], _CLASS[10] = _SPACE, _END


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


def parse_model(raw: bytes) -> dict:
    """pieces [(piece, score, kind)], model kind, byte_fallback, unk_id and the normaliser's rules."""
    pieces, trainer, norm = [], {}, {}
    for k, v in _fields(raw):
        if k == 1:
            f = dict(_fields(v))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif k == 2:
            trainer = dict(_fields(v))
        elif k == 3:
            norm = dict(_fields(v))
    return {
        "pieces": pieces,
        "kind": trainer.get(3, UNIGRAM),
        "byte_fallback": bool(trainer.get(35, 0)),
        "unk_id": trainer.get(40, 0),
        "charsmap": norm.get(2, b""),
        "dummy_prefix": bool(norm.get(3, 1)),
        "squeeze": bool(norm.get(4, 1)),
        "suffix": bool(trainer.get(24, 0)),
    }


def _model(m: dict) -> models.Model:
    pieces = m["pieces"]
    if m["kind"] == UNIGRAM:
        return models.Unigram([(p, s) for p, s, _ in pieces], unk_id=m["unk_id"], byte_fallback=m["byte_fallback"])
    if m["kind"] != BPE:
        raise ValueError("only unigram and BPE models are known")
    vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
    usable = {p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    made = []
    for i, (p, score, _) in enumerate(pieces):
        if p in usable and len(p) > 1:
            made += [(-score, i, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
    made.sort()
    return models.BPE(vocab=vocab, merges=[(a, b) for *_, a, b in made], unk_token=pieces[m["unk_id"]][0], fuse_unk=True, byte_fallback=m["byte_fallback"])


def build(m: dict, normalise: bool = True) -> Tokenizer:
    """A tokenizer for a parsed model; with normalise=False, for units that are normalised already."""
    if m["suffix"]:
        raise ValueError("markers as suffixes are not known")
    t = Tokenizer(_model(m))
    if normalise:
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["squeeze"]:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if m["dummy_prefix"]:
            steps.append(normalizers.Prepend(MARK))
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if separable(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(UNIT), behavior="isolated")
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*steps, *([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else [])])
    t.add_special_tokens([AddedToken(p, normalized=False, special=True) for p, _, kind in m["pieces"] if kind in (UNKNOWN, CONTROL)])
    t.encode_special_tokens = True
    return t


def separable(m: dict) -> bool:
    """Whether every piece lies within one unit. Without byte fallback, unknown characters of neighbouring units join."""
    return m["byte_fallback"] and all(re.fullmatch(UNIT, p) for p, _, kind in m["pieces"] if kind in (NORMAL, USER_DEFINED))


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, raw: bytes) -> None:
        # Threads of the library's batches; it was not used in this process before, so they are safe after the fork.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = parse_model(raw)
        self.units = build(self.model, normalise=False)
        self.direct = not separable(self.model) or self.model["charsmap"] or self.model["squeeze"]
        self.cache = UnitCache(self._encode)
        self.split = re.compile(UNIT).findall
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model["pieces"]]

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """For whole texts; made where they are met."""
        return build(self.model)

    def _batch(self, tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, units: list[str]) -> Iterator[bytes]:
        """Many units at once: a line end is a unit of its own, and its id occurs nowhere else."""
        units = [x.replace(" ", MARK) for x in units]
        mark = self._batch(self.units, ["\n"])[0]
        groups = [units[i : i + TOGETHER] for i in range(0, len(units), TOGETHER)]
        for group, raw in zip(groups, self._batch(self.units, ["\n".join(g) for g in groups]), strict=True):
            yield from split_ids(raw, mark, len(group)) or self._batch(self.units, group)

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """Units of plain texts by the classes of their bytes; a space stands for a marker."""
        raws = [((" " if self.model["dummy_prefix"] else "") + x).encode() if x else b"" for x in texts]
        data = b"".join(raws)
        begin = np.cumsum([0, *(len(x) for x in raws[:-1])])
        kind = _CLASS[np.frombuffer(data, np.uint8)]
        before = np.append(kind[:1], kind[:-1])
        # A unit starts at a line end, at the first of several markers, and where a class follows another but a marker.
        new = (kind == _END) | (kind != before) & (before != _SPACE)
        new[begin[begin < len(new)]] = True
        starts = np.flatnonzero(new)
        yield from encode_units(data, starts, np.append(starts[1:], len(kind)), begin, self.cache)

    def _other(self, text: str) -> bytes:
        prefix = MARK if self.model["dummy_prefix"] else ""
        return b"".join(self.cache.ids([x.encode() for x in self.split(prefix + text.replace(" ", MARK))]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        if not self.direct:
            yield from in_blocks(texts, PLAIN.fullmatch, self._plain, self._other)
            return
        held: list[str] = []
        size = 0
        for x in texts:
            held.append(x)
            size += len(x)
            if size > BLOCK:
                yield from self._batch(self.tokenizer, held)
                held, size = [], 0
        yield from self._batch(self.tokenizer, held)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: list[int]) -> bytes:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:] if self.model["dummy_prefix"] and raw[:1] == b" " else raw


_HELD: dict[str, tuple] = {}


def _held(path: str) -> tuple:
    import sentencepiece

    if path not in _HELD:
        with open(path, "rb") as f:
            raw = f.read()
        _HELD[path] = PieceEncoder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        release()
    return _HELD[path]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned, of little-endian 32-bit ids), parity (ids are those of sentencepiece),
    round_trip (decoding gives the text back) and, if `with_ids`, ids (array)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, other = _held(path)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            out: tuple[list, ...] = ([], [], [], [])
            raws: list[bytes] = []
            for text, raw in zip(texts, enc.encode_all(texts), strict=True):
                theirs = other.encode(text)
                parity = array("I", theirs).tobytes() == raw
                got = theirs if parity else np.frombuffer(raw, "<u4").tolist()
                for col, v in zip(out, (len(got), zlib.crc32(raw), parity, enc.decode_bytes(got) == text.encode("utf-8", "surrogatepass")), strict=True):
                    col.append(v)
                if with_ids:
                    raws.append(raw)
            cols = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.bool_())]
            names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip"]
            if with_ids:
                offsets = np.cumsum([0, *out[0]], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {kind}, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = _held(path)
        for b in batches:
            texts = [None if x.as_py() is None else enc.decode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(column(encoded, id_col).alias("doc_id"), column(encoded, ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(encoded.dtypes)[id_col]}, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
