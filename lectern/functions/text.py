"""Text expressions: stripping, cleaning, cutting, counting. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{P.SPACE}+", "")


def rstrip(text: Column) -> Column:
    # The lookbehind keeps a long run inside the text from being tried at each of its places.
    return F.regexp_replace(text, rf"(?U)(?<!{P.SPACE}){P.SPACE}+\z|\A{P.SPACE}+\z", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (trim() knows only the space)."""
    return lstrip(rstrip(text))


def present(text: Column) -> Column:
    """Whether anything but white space is there."""
    return F.coalesce(text, F.lit("")).rlike(rf"(?U)(?!{P.SPACE})(?s:.)")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, P.LINE_ENDING, "\n")


#: Steps of cleaning after line ends, in order: name, pattern, replacement.
STEPS = (
    ("data_uri", P.DATA_URI, ""),
    ("html_comments", P.HTML_COMMENT, ""),
    ("md_images", P.MD_IMAGE, ""),
    ("emoji_codes", P.EMOJI_CODE, ""),
    ("html_tags", P.HTML_TAG, ""),
    ("decorative_lines", P.DECORATIVE_LINE, ""),
    ("spaces", P.EXCESS_SPACES, " "),
    ("blank_lines", P.EXCESS_BLANK_LINES, "\n\n"),
)


def cleaned(text: Column) -> Column:
    """Text without markup and decoration; null becomes empty."""
    out = newlines(F.coalesce(text, F.lit("")))
    for _, pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def removed(before: Column, after: Column) -> Column:
    """Characters that cleaning removed; line ends do not count."""
    return F.greatest(F.lit(0), F.length(newlines(F.coalesce(before, F.lit("")))) - F.length(after)).cast("long")


def truncated(text: Column, cap: Column) -> Column:
    """Text cut at `cap` characters with a mark; a null cap is none."""
    cut = F.concat(rstrip(F.substring(text, F.lit(1), cap.cast("int"))), F.lit(" …[truncated]"))
    return F.when(cap.isNull() | (F.length(text) <= cap), text).otherwise(cut)


def first_line(text: Column) -> Column:
    """The first line with anything in it, stripped."""
    return strip(F.regexp_extract(text, P.FIRST_LINE, 1))


def token_heuristic(text: Column) -> Column:
    """The larger estimate by words and by characters, rounded half to even; 0 for no text."""
    text = F.coalesce(text, F.lit(""))
    # 1.33 tokens a word, in hundredths so that halves are exact.
    words = half_even(F.regexp_count(text, F.lit(P.WORD)).cast("long") * 133, 100)
    chars = half_even(F.length(text).cast("long"), 4)
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(words, chars, present(text).cast("long"))).cast("long")


def half_even(number: Column, by: int) -> Column:
    """number / by, rounded half to even, for whole numbers from 0."""
    down = F.floor(number / F.lit(by)).cast("long")
    twice = (number - down * by) * 2
    return down + F.when((twice > by) | ((twice == by) & (down % 2 == 1)), 1).otherwise(0)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def title(name: Column, nickname: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(nickname, F.lit("")), F.lit("(unnamed)"))
