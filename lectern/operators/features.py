"""Per-card detectors: which conventions a card's fields show. One projection, no shuffle, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

CORE = ("name", "description", "personality", "scenario", "first_mes", "mes_example")


def header_markers(description: Column) -> Column:
    return F.regexp_extract_all(description, F.lit(P.SECTION_HEADER), F.lit(1))


def header_names(description: Column) -> Column:
    return F.regexp_extract_all(description, F.lit(P.SECTION_HEADER), F.lit(2))


def named_blocks(description: Column) -> Column:
    """Distinct lower-case names of <X> blocks that are closed later."""
    names = F.array_distinct(F.regexp_extract_all(description, F.lit(P.XML_BLOCK), F.lit(1)))

    def closed(x: Column) -> Column:
        opened = F.position(F.concat(F.lit("<"), x, F.lit(">")), description)
        return F.position(F.concat(F.lit("</"), x, F.lit(">")), description, opened) > 0

    found = F.array_distinct(F.transform(F.filter(names, closed), lambda x: F.lower(F.trim(x))))
    return F.when(F.contains(description, F.lit("</")), found).otherwise(F.array().cast("array<string>"))


def paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), X.present))


def multi_character(name: Column, description: Column) -> Column:
    return description.rlike(P.NPC_BLOCK) | name.rlike(P.GROUP_NAME)


def features(cards: DataFrame) -> DataFrame:
    """Cards with their flags and counts. Texts must not be null."""
    c = F.col
    combined = F.concat_ws("\n", "description", "personality", "scenario", "first_mes", "mes_example")
    first = cards.withColumns({
        "has_example": X.present(c("mes_example")),
        "has_first_mes": X.present(c("first_mes")),
        "has_description": X.present(c("description")),
        "has_scenario": X.present(c("scenario")),
        "char_placeholder": combined.rlike(P.CHAR_PLACEHOLDER),
        "user_placeholder": combined.rlike(P.USER_PLACEHOLDER),
        "backtick": combined.rlike(P.BACKTICK_THOUGHT),
        "start_marker": c("mes_example").rlike(P.START_MARKER),
        "turns": F.regexp_count("mes_example", F.lit(P.TURN_LINE)).cast("long"),
        "asterisk": c("first_mes").rlike(P.ASTERISK_ACTION) | c("mes_example").rlike(P.ASTERISK_ACTION),
        "quoted": c("first_mes").rlike(P.QUOTED_SPEECH),
        "opens_action": X.lstrip(c("first_mes")).rlike(P.OPENS_WITH_ACTION),
        "ends_speech": X.rstrip(c("first_mes")).rlike(P.ENDS_ON_SPEECH),
        "status_line": X.first_line(c("first_mes")).rlike(P.STATUS_LINE),
        "paragraphs": paragraphs(c("first_mes")).cast("long"),
        "found_markers": header_markers(c("description")),
        "found_names": header_names(c("description")),
        "plus_bullet": c("description").rlike(P.PLUS_BULLET),
        "xml_block": c("description").rlike(P.XML_BLOCK),
        "npc_block": c("description").rlike(P.NPC_BLOCK),
        "named_blocks": named_blocks(c("description")),
        "multi_character": multi_character(c("name"), c("description")),
        "instructions": c("scenario").rlike(P.INSTRUCTIONS_BLOCK),
        "description_chars": F.length("description").cast("long"),
    })
    enough = F.size("found_names") >= P.MIN_SECTION_HEADERS
    second = first.withColumns({
        "section_markers": F.when(enough, c("found_markers")).otherwise(F.array().cast("array<string>")),
        "section_names": F.when(enough, c("found_names")).otherwise(F.array().cast("array<string>")),
    }).drop("found_markers", "found_names")
    marked = 2 * F.size(F.filter("section_markers", lambda m: m == ">")) >= F.size("section_markers")
    style = F.concat(F.when(marked, "marked").otherwise("bare"), F.lit("_"), F.when(c("plus_bullet"), "bulleted").otherwise("plain"))
    return second.withColumns({
        "sections": F.size("section_names") > 0,
        "section_style": F.when((F.size("section_names") > 0) & c("has_description"), style),
        "distinct_sections": F.size(F.array_distinct(F.transform("section_names", lambda x: F.lower(F.trim(x))))),
    })
