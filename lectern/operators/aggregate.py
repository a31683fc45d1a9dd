"""Corpus aggregates: each is one hash aggregate with map-side combination over the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.session import cut
from .features import CORE

c = F.col


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def median_round(value: Column) -> Column:
    """Median of whole numbers, rounded half to even; 0 without any. Exact: twice a median of whole numbers is whole."""
    return F.coalesce(X.half_even((F.median(value) * 2).cast("long"), 2), F.lit(0)).cast("long")


def conv_summary(features: DataFrame) -> DataFrame:
    """All counts of the conventions in one row, in one pass."""
    first, described, example = c("has_first_mes"), c("has_description"), c("has_example")
    sections = described & c("sections")
    return features.agg(
        F.count("*").alias("total_cards"),
        _n(c("multi_character")).alias("multi_character_cards"),
        _n(example).alias("cards_with_example"),
        _n(first).alias("cards_with_first_mes"),
        _n(described).alias("cards_with_description"),
        _n(c("has_scenario")).alias("cards_with_scenario"),
        _n(c("char_placeholder")).alias("char_placeholder"),
        _n(c("user_placeholder")).alias("user_placeholder"),
        _n(example & c("start_marker")).alias("start_marker"),
        _n(example & (c("turns") > 0)).alias("turn_prefixed_example"),
        median_round(F.when(example & (c("turns") > 0), c("turns"))).alias("median_example_turns"),
        _n(first & c("asterisk")).alias("asterisk_action"),
        _n(first & c("quoted")).alias("quoted_speech"),
        _n(c("backtick")).alias("backtick_thoughts"),
        median_round(F.when(first, c("paragraphs"))).alias("median_first_mes_paragraphs"),
        _n(first & c("opens_action")).alias("first_mes_opens_action"),
        _n(first & c("ends_speech")).alias("first_mes_ends_speech"),
        _n(first & c("status_line")).alias("first_mes_status_line"),
        _n(sections).alias("section_header_cards"),
        _n(sections & c("section_style").startswith("marked")).alias("section_marker_cards"),
        _n(described & c("plus_bullet")).alias("plus_bullet_cards"),
        _n(described & c("xml_block")).alias("xml_block_cards"),
        _n(described & c("npc_block")).alias("npc_block_cards"),
        _n(described & (F.size("named_blocks") >= 2)).alias("per_character_block_cards"),
        _n(c("has_scenario") & c("instructions")).alias("scenario_instructions_cards"),
        median_round(F.when(described, c("description_chars"))).alias("median_description_chars"),
    )


def field_coverage(features: DataFrame) -> DataFrame:
    """field, cards that fill it: the core fields and tags."""
    one = features.agg(*(_n(X.present(c(f))).alias(f) for f in CORE), _n(F.size("tags") > 0).alias("tags"))
    return one.unpivot([], [*CORE, "tags"], "field", "cards")


def section_style_counts(features: DataFrame) -> DataFrame:
    """section_style, cards: all four styles, 0 included."""
    one = features.agg(*(_n(c("section_style") == s).alias(s) for s in P.SECTION_STYLES))
    return one.unpivot([], list(P.SECTION_STYLES), "section_style", "cards")


def dominant_style(features: DataFrame) -> DataFrame:
    """The most common style; the more structured one of equals."""
    n = [F.count_if(c("section_style") == s) for s in P.SECTION_STYLES]
    most = F.greatest(*n)
    style = F.coalesce(*(F.when((x == most) & (most > 0), s) for x, s in zip(n, P.SECTION_STYLES, strict=True)))
    return features.agg(F.coalesce(style, F.lit(P.SECTION_STYLES[0])).alias("section_style"), most.alias("cards"))


def section_names(features: DataFrame) -> DataFrame:
    """Names common among cards with sections: name, cards, mean relative position, in the order of positions.

    Within a card a name counts once whatever its case; across cards spellings count apart.
    """
    own = features.where(c("has_description") & c("sections")).select("ord", "section_names")
    last = F.greatest(F.size("section_names") - 1, F.lit(1))
    first = F.transform("section_names", lambda x, i: F.struct(X.strip(x).alias("name"), (i / last).alias("at"), i.alias("i")))
    # A name's first place in its card, found within the row: no shuffle by card is needed. One nameless entry counts the card.
    once = F.filter(first, lambda s: F.array_position(F.transform(first, lambda t: F.lower(t["name"])), F.lower(s["name"])) == s["i"] + 1)
    card = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("at"), F.lit(-1).alias("i")))
    seen = own.select("ord", F.explode(F.concat(once, card)).alias("s")).select("ord", "s.name", "s.at", "s.i")
    by_name = cut(seen.groupBy("name").agg(F.count("*").alias("cards"), F.avg("at").alias("position"), F.min(F.struct("ord", "i")).alias("first_seen")))
    counted = by_name.where("name is null").first()
    total = counted["cards"] if counted else 0
    kept = by_name.where(c("name").isNotNull() & (c("cards") >= P.COMMON_SHARE * total) & (c("cards") >= P.MIN_SECTION_NAME_CARDS))
    place = F.row_number().over(Window.orderBy("position", "first_seen"))  # of the few names at or above the share
    return kept.select("name", "cards", F.round("position", 6).alias("position"), place.cast("long").alias("place"))


def corpus_stats(features: DataFrame) -> DataFrame:
    multi, described = _n(c("multi_character")), c("description") != ""
    length = F.when(described, c("description_chars"))
    return features.agg(
        F.count("*").alias("count"),
        multi.alias("multi_character_cards"),
        (F.count("*") - multi).alias("single_character_cards"),
        F.coalesce(_average(F.sum(length), F.count(length)), F.lit(0)).alias("avg_description_chars"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_description_chars"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_description_chars"),
        (F.count("*") - _n(described)).alias("cards_missing_description"),
        F.coalesce(F.sum("bloat_chars_removed"), F.lit(0)).alias("total_bloat_chars_removed"),
        _n(c("bloat_chars_removed") > 0).alias("cards_with_bloat"),
    )


def _average(total: Column, n: Column) -> Column:
    """total / n, rounded half to even; null for none."""
    down = F.floor(total / n).cast("long")
    twice = (total - down * n) * 2
    return F.when(n > 0, down + F.when((twice > n) | ((twice == n) & (down % 2 == 1)), 1).otherwise(0))


def top_tags(cards: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent tags, the first seen first of equals."""
    tags = cards.select("ord", F.posexplode("tags").alias("i", "tag")).select("ord", "i", F.lower(X.strip(c("tag"))).alias("tag")).where("tag != ''")
    return tags.groupBy("tag").agg(F.count("*").alias("cards"), F.min(F.struct("ord", "i")).alias("seen")).orderBy(F.desc("cards"), "seen").limit(n).select("tag", "cards")


def spec_versions(cards: DataFrame) -> DataFrame:
    return cards.groupBy("spec_version").agg(F.count("*").alias("cards"))


def top_bloat(cards: DataFrame, n: int = 3) -> DataFrame:
    """The n cards that lost most to cleaning, the first of equals first."""
    some = cards.where("bloat_chars_removed > 0").orderBy(F.desc("bloat_chars_removed"), "ord").limit(n)
    return some.select(X.title(c("name"), c("nickname")).alias("card"), "bloat_chars_removed")


def truncation_ratio(cards: DataFrame, cap: int = P.MAX_CHARS) -> DataFrame:
    """Description characters that a cap shows, and all."""
    length = F.length("description").cast("long")
    return cards.agg(F.coalesce(F.sum(F.least(length, F.lit(cap))), F.lit(0)).cast("long").alias("shown"), F.coalesce(F.sum(length), F.lit(0)).alias("actual"))


#: A convention's count, and the count that it is a share of.
SHARES = {
    "char_placeholder": "total_cards",
    "user_placeholder": "total_cards",
    "backtick_thoughts": "total_cards",
    "start_marker": "cards_with_example",
    "turn_prefixed_example": "cards_with_example",
    "asterisk_action": "cards_with_first_mes",
    "quoted_speech": "cards_with_first_mes",
    "first_mes_opens_action": "cards_with_first_mes",
    "first_mes_ends_speech": "cards_with_first_mes",
    "first_mes_status_line": "cards_with_first_mes",
    "section_header_cards": "cards_with_description",
    "plus_bullet_cards": "cards_with_description",
    "xml_block_cards": "cards_with_description",
    "npc_block_cards": "cards_with_description",
    "per_character_block_cards": "cards_with_description",
    "scenario_instructions_cards": "cards_with_scenario",
}


def convention_shares(summary: DataFrame) -> DataFrame:
    """convention, n, total, pct (half to even), dominant, common, universal: one row for each of SHARES."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("convention"), c(k).alias("n"), c(v).alias("total")) for k, v in SHARES.items())))
    out = summary.select(rows.alias("r")).select("r.*")
    enough = c("total") >= P.MIN_CARDS
    return out.select(
        "convention", "n", "total",
        F.coalesce(_average(c("n") * 100, c("total")), F.lit(0)).alias("pct"),
        (enough & (c("n") * 2 >= c("total"))).alias("dominant"),
        (enough & ((c("n") * 4 >= c("total")) | (c("n") >= P.MIN_STRUCTURE_CARDS))).alias("common"),
        ((c("total") > 0) & (c("n") * 5 >= c("total") * 4)).alias("universal"),
    )


def share_texts(shares: DataFrame) -> DataFrame:
    """convention, share: a count and its share as text, thousands set apart."""
    number = lambda x: F.format_number(c(x), 0)
    return shares.select("convention", F.concat(number("n"), F.lit(" of "), number("total"), F.lit(" cards ("), c("pct").cast("string"), F.lit("%)")).alias("share"))
