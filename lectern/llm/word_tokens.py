"""Token ids of texts by the tokenizers library, with each distinct piece of text encoded once.

A tokenizer that splits its input before it merges gives a piece the same ids wherever it stands, so ids are made by the
library for pieces not met before and then kept. This holds for files with the rules of `RULES`; any other file's texts go to the
library whole. So do texts with characters outside `SIMPLE`, whose normalisation or
classes could differ between Python and the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

# Each of the library's threads holds memory of its own, and an executor runs a worker on every core.
os.environ.setdefault("RAYON_NUM_THREADS", "2")
#: Letters whose lower case, composition and class are the same everywhere: ASCII and Latin with diacritics.
LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ž"
SIMPLE = re.compile(f"[\\t\\n\\r -~{LETTERS}¡«»¿–—‘’“”…€]*")
#: Normaliser and splitting rule of the files that pieces are told apart for.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
#: The vocabulary's own splitting rule, for SIMPLE texts in lower case.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^ \\t\\n\\r0-9{LETTERS}]+").findall
#: Units kept by a worker, at most about 60 MB; places of the marks that tell whether a unit was met before.
CACHE, MARKS = 200_000, 1 << 22
#: Bytes of text that are split at once; units that are encoded at once.
BLOCK, TOGETHER = 2 << 20, 2048


class UnitCache:
    """Ids of units of text, by their bytes. A unit stays once two blocks had it, so that the many that occur once take no room."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]]) -> None:
        self.encode, self.kept, self.met = encode, {}, np.zeros(MARKS, np.bool_)

    def ids(self, units: list[bytes]) -> list[bytes]:
        if len(self.kept) > CACHE:
            self.kept = {x: self.kept[x] for x in units if x in self.kept}
        out = list(map(self.kept.get, units))
        missing = [i for i, x in enumerate(out) if x is None]
        new = list(dict.fromkeys([units[i] for i in missing]))
        fresh = dict(zip(new, self.encode([x.decode() for x in new]), strict=True))
        for i in missing:
            out[i] = fresh[units[i]]
        place = np.fromiter(map(hash, new), np.int64, len(new)) & (MARKS - 1)
        for i in np.flatnonzero(self.met[place]).tolist():
            self.kept[new[i]] = fresh[new[i]]
        self.met[place] = True
        return out


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def encode_units(data: bytes, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, cache: UnitCache) -> Iterator[bytes]:
    """The ids of each text of `data`, from units [starts, ends) in order; texts: where each text starts. No byte may be 0.

    Units of up to 16 bytes are told apart by those bytes as two numbers, longer ones one by one, so each distinct unit of the
    block is looked up once.
    """
    n = len(data)
    buf = np.frombuffer(data + bytes(24), np.uint8)
    words = np.empty(n + 16, np.uint64)
    for r in range(8):
        part = np.frombuffer(buf, "<u8", (n + 16 - r + 7) // 8, r)
        words[r::8] = part
    size = ends - starts
    low = words[starts] & _MASKS[np.minimum(size, 8)]
    high = words[starts + 8] & _MASKS[np.clip(size - 8, 0, 8)]
    key = low ^ (high * np.uint64(0x9E3779B97F4A7C15) ^ high >> np.uint64(31))
    short = np.flatnonzero(size <= 16)
    which = np.empty(len(starts), np.int64)
    _, first, inverse = np.unique(key[short], return_index=True, return_inverse=True)
    head = short[first]
    which[short] = inverse
    odd = short[(low[short] != low[head][inverse]) | (high[short] != high[head][inverse])]  # other bytes under the same key
    alone = np.concatenate([np.flatnonzero(size > 16), odd])
    which[alone] = len(head) + np.arange(len(alone))
    each = np.concatenate([head, alone])
    ids = cache.ids([data[i:j] for i, j in zip(starts[each].tolist(), ends[each].tolist(), strict=True)])
    lens = np.array([len(x) for x in ids], np.int64) // 4
    at = np.cumsum(lens) - lens
    count = lens[which]
    stop = np.cumsum(count)
    total = int(stop[-1]) if len(stop) else 0
    out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(at[which] - (stop - count), count) + np.arange(total)]
    edge = np.append(0, stop)[np.append(np.searchsorted(starts, texts), len(starts))].tolist()
    for i, j in zip(edge, edge[1:], strict=False):
        yield out[i:j].tobytes()


def split_ids(raw: bytes, mark: bytes, n: int) -> list[bytes] | None:
    """The n parts of 4-byte ids between marks; None where there is another number of them."""
    ids = np.frombuffer(raw, "<u4")
    at = np.flatnonzero(ids == np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else ids[:0]
    if len(at) != n - 1:
        return None
    ends = (4 * np.concatenate([[-1], at, [len(ids)]])).tolist()
    return [raw[i + 4 : j] for i, j in zip(ends, ends[1:])]


#: Texts that the byte classes below are right for: ASCII and two-byte letters, no contraction, no special token.
PLAIN = re.compile("[\t\n\r -&(-~À-ÖØ-öø-įı-ňŊ-ž]*")
_CLASS = np.full(256, 1, np.uint8)  # letters: 1, also as the bytes above ASCII
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[x for x in range(33, 127) if not chr(x).isalpha()]] = 2
_CLASS[48:58] = 3


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes; `split` tells whether the file's rules allow piece by piece."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        # Special tokens are looked for by their common start.
        self.split = all(rules[k] == v for k, v in RULES.items()) and all(x["content"].startswith("<|") for x in rules["added_tokens"])
        self.cache = UnitCache(self._encode)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        """Many pieces at once: between spaces they are split where they were, and a digit, whose id only it has, stands between them."""
        mark = self._ids(["0"])[0]
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        for group, raw in zip(groups, self._ids([" 0 ".join(g) for g in groups]), strict=True):
            yield from split_ids(raw, mark, len(group)) or self._ids(group)

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        raws = [x.lower().encode() for x in texts]
        data = b"\n".join(raws)
        begin = np.cumsum([0, *(len(x) + 1 for x in raws[:-1])])
        kind = _CLASS[np.frombuffer(data, np.uint8)]
        new = np.empty(len(kind), np.bool_)
        new[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == 3
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(kind))
        full = kind[starts] != 0
        yield from encode_units(data, starts[full], ends[full], begin, self.cache)

    def _other(self, text: str) -> bytes:
        if "<|" in text or not SIMPLE.fullmatch(text):
            return self._ids([text])[0]
        return b"".join(self.cache.ids([x.encode() for x in _SPLIT(text.lower())]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        if not self.split:
            yield from in_blocks(texts, lambda x: True, self._ids, lambda x: self._ids([x])[0])
            return
        yield from in_blocks(texts, lambda x: "<|" not in x and PLAIN.fullmatch(x), self._plain, self._other)


def in_blocks(texts: Iterable[str], is_plain: Callable[[str], object], plain: Callable[[list[str]], Iterator[bytes]], other: Callable[[str], bytes]) -> Iterator[bytes]:
    """Results in the order of texts: plain ones in blocks of about BLOCK characters, others one by one."""
    held: list[str] = []
    done: list[bytes | None] = []
    size = 0

    def finish() -> Iterator[bytes]:
        made = iter(plain(held) if held else ())
        for x in done:
            yield next(made) if x is None else x

    for text in texts:
        if is_plain(text):
            held.append(text)
            done.append(None)
        else:
            done.append(other(text))
        size += len(text)
        if size > BLOCK:
            yield from finish()
            held, done, size = [], [], 0
    yield from finish()


_HELD: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _HELD:
        _HELD[path] = WordEncoder(path)
    return _HELD[path]
