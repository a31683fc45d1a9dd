"""Scores, ranks, selections and the agreement of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.session import cut

c = F.col


def score_thousandths() -> Column:
    """What a card can teach, in thousandths of a point: all terms are whole there."""
    flag = lambda x, points: F.when(x, points).otherwise(0)
    return (
        F.least(c("distinct_sections"), F.lit(8)) * 6000
        + flag(c("plus_bullet"), 8000)
        + flag(c("xml_block"), 6000)
        + F.least(c("description_chars"), F.lit(12_000))
        + F.least(F.length("first_mes") * 2, F.lit(8000))
        + flag(c("has_scenario"), 5000)
        + flag(c("has_example"), 4000)
        + flag(F.size("tags") > 0, 2000)
        + flag(X.present(c("creator_notes")), 1000)
        + flag(F.size("alternate_greetings") > 0, 2000)
        + flag(F.size("lorebook_entries") > 0, 4000)
    ).cast("long")


def scored(features: DataFrame) -> DataFrame:
    """Features with score, in hundredths of a point rounded half to even."""
    return features.withColumn("score", X.half_even(score_thousandths(), 10))


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with each row's place (from 1) in a global order.

    Rows are sorted by ranges in parallel and numbered within their range; only the ranges' counts meet in one task. `df` should
    be narrow: it is written first, as finding the ranges and sorting by them would compute it twice.
    """
    ranged = cut(df).repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    placed = cut(ranged.withColumns({"range__": F.shiftright(own, 33), "nth__": own.bitwiseAND((1 << 33) - 1)}))
    before = placed.groupBy("range__").agg(F.count("*").alias("n")).withColumn("before__", F.coalesce(F.sum("n").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return placed.join(F.broadcast(before), "range__").withColumn(name, c("before__") + c("nth__") + 1).drop("range__", "nth__", "before__")  # a row for each shuffle partition


def best_first() -> list[Column]:
    return [F.desc("score"), F.lower("name"), F.asc("ord")]


def rank_cards(scored_cards: DataFrame, *more: str) -> DataFrame:
    """ord, name, score, `more` columns, rank: the best first, then by name, then by order found."""
    return numbered(scored_cards.select("ord", "name", "score", *more), best_first())


def select_best(scored_cards: DataFrame, limit: int | None) -> DataFrame:
    """The best `limit` cards (all for none, 0 or less), by a bounded heap in each task."""
    ordered = scored_cards.orderBy(*best_first())
    return ordered.limit(limit) if limit and limit > 0 else ordered


def exemplars(scored_cards: DataFrame, n: int = 3) -> DataFrame:
    """Names of the best n, of those with a name and a score; there may be fewer."""
    top = select_best(scored_cards.select("ord", "name", "nickname", "score"), n)
    name = X.strip(F.coalesce(F.nullif("name", F.lit("")), c("nickname")))
    return top.select("ord", name.alias("name"), "score").where("name != '' and score > 0")


def apply_pins(ranked: DataFrame, pinned_files: DataFrame) -> DataFrame:
    """ranked (with source_file, rank) and place: pinned cards first, both parts in their order."""
    pins = pinned_files.where("source_file != ''").select("source_file").distinct().withColumn("pinned", F.lit(True))
    joined = ranked.join(pins, "source_file", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return numbered(joined, [F.desc("pinned"), F.asc("rank")], "place")


def without(cards: DataFrame, removed_files: DataFrame) -> DataFrame:
    """Cards but those whose source_file was removed; an empty name removes nothing."""
    gone = removed_files.where("source_file != ''").select("source_file").distinct()
    return cards.join(gone, "source_file", "left_anti").select(*cards.columns)


def structure_consistency(scored_cards: DataFrame) -> DataFrame:
    """cards, structured, agreeing_prefix, stable: how far down the ranking cards agree on sections.

    Running counts are taken within ranges of the ranking and added to those of earlier ranges.
    """
    flags = cut(scored_cards.where("has_description").select("ord", "name", "score", F.when(c("sections"), 1).otherwise(0).cast("long").alias("flag")))
    order = best_first()
    ranged = flags.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    placed = cut(ranged.select("flag", F.shiftright(own, 33).alias("range"), own.bitwiseAND((1 << 33) - 1).alias("nth")))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("flag").alias("s")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("flags_before"))
    within = F.sum("flag").over(Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    running = placed.withColumn("within", within).join(F.broadcast(before), "range")
    at, total = c("rows_before") + c("nth") + 1, c("flags_before") + c("within")
    return running.agg(
        F.count("*").alias("cards"),
        F.coalesce(F.sum("flag"), F.lit(0)).alias("structured"),
        F.coalesce(F.max(F.when(total * 10 >= at * int(10 * P.AGREEMENT_BAR), at)), F.lit(0)).alias("agreeing_prefix"),
        (F.count("*") >= P.MIN_STABLE_CARDS).alias("stable"),
    )


def tier_cap(place: Column, cap: int | None, full_top: int = P.FULL_TOP) -> Column:
    """No cap (null) for the first `full_top` places, then `cap`."""
    if cap is None:
        return F.lit(None).cast("int")
    return F.lit(cap) if full_top <= 0 else F.when(place > full_top, F.lit(cap))


def field_cap(tier: Column, hard: int | None) -> Column:
    """The tighter of the tier's cap and a field's own; null is none."""
    return tier if hard is None else F.least(tier, F.lit(hard))
