"""Token counts: the heuristic as an expression, exact counts by a library where its data are at hand."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

#: Names of tokenizers, their library and key, and what they are called in reports.
PRESETS = {
    "gpt": ("tiktoken", "cl100k_base", "tiktoken/cl100k_base (GPT-4/3.5-exact)"),
    "deepseek": ("hf", "deepseek-ai/DeepSeek-V3", "deepseek-ai/DeepSeek-V3 tokenizer"),
    "glm": ("hf", "zai-org/GLM-4.5", "zai-org/GLM-4.5 tokenizer"),
}
HEURISTIC = "heuristic (~4 chars/token)"


@dataclass(frozen=True)
class TokenCount:
    count: int
    method: str
    exact: bool


def heuristic(text: str) -> int:
    """The expression's count, for text on the driver."""
    if not text:
        return 0
    half = lambda n, by: n // by + (2 * (n % by) > by or (2 * (n % by) == by and n // by % 2 == 1))
    return max(half(len(text.split()) * round(100 * P.TOKENS_PER_WORD), 100), half(len(text), P.CHARS_PER_TOKEN), int(bool(text.strip())))


def resolve(name: str | None) -> tuple[str, str | None, str]:
    """Library, key and label of a tokenizer's name; the path of a tokenizer's JSON file is one; an unknown name is the heuristic."""
    if name and name.endswith(".json"):
        return "file", name, f"{os.path.basename(name)} tokenizer"
    if name in PRESETS:
        return PRESETS[name]
    if name and name != "heuristic" and "/" in name:
        return "hf", name, f"{name} tokenizer"
    return "heuristic", None, "heuristic"


_held: dict[tuple[str, str], tuple[object | None, str | None]] = {}


def load(kind: str, key: str) -> tuple[object | None, str | None]:
    """A counting function and no reason, or none and the reason; once for each process."""
    if (kind, key) not in _held:
        try:
            if kind == "tiktoken":
                import tiktoken

                enc = tiktoken.get_encoding(key)
                _held[kind, key] = (lambda t: len(enc.encode(t, disallowed_special=()))), None
            else:
                from tokenizers import Tokenizer

                tok = Tokenizer.from_file(key) if kind == "file" else Tokenizer.from_pretrained(key)
                _held[kind, key] = (lambda t: len(tok.encode(t).ids)), None
        except ImportError:
            _held[kind, key] = None, f"`{kind}` not installed"
        except Exception as e:  # no network, gated data, damaged files: all mean the heuristic
            _held[kind, key] = None, f"couldn't fetch {key} ({type(e).__name__})"
    return _held[kind, key]


def count_tokens(text: str, tokenizer: str = "heuristic") -> TokenCount:
    kind, key, label = resolve(tokenizer)
    if kind == "heuristic":
        return TokenCount(heuristic(text), HEURISTIC, False)
    count, reason = load(kind, key)
    if count is None:
        return TokenCount(heuristic(text), f"heuristic - {label} unavailable: {reason}", False)
    try:
        return TokenCount(count(text), label, True)
    except Exception:
        return TokenCount(heuristic(text), f"heuristic - {label} failed on this text", False)


def tokens_of(text: Column, tokenizer: str = "heuristic") -> Column:
    """Token counts of a column; the library is tried on the driver first, so that a fallback costs no Python workers."""
    kind, key, _ = resolve(tokenizer)
    if kind == "heuristic" or load(kind, key)[0] is None:
        return X.token_heuristic(text)

    @F.pandas_udf("long")
    def exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: count_tokens(t or "", tokenizer).count)

    return exact(text)
