"""Cards as export blocks: one text column for each format, built from cut fields in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .select import field_cap, tier_cap

c = F.col

#: Optional fields, and those a cap can be set for.
EXTRA_FIELDS = ("tags", "creator_notes", "system_prompt", "post_history_instructions", "alt_greetings", "lorebook")
DEFAULT_EXTRA = frozenset({"tags"})
CAPPABLE = ("description", "personality", "scenario", "first_mes", "mes_example", "creator_notes", "system_prompt", "post_history_instructions", "alt_greetings", "lorebook")

# The labels of each format, in its order of fields.
MD_LABELS = {
    "tags": "- Tags: ", "description": "- Description: ", "personality": "- Personality: ", "scenario": "- Scenario: ", "first_mes": "- First message: ",
    "mes_example": "- Example dialogue: ", "creator_notes": "- Creator notes: ", "alt_greetings": "- Alt greetings (N):", "system_prompt": "- System prompt: ",
    "post_history_instructions": "- Post-history instructions: ", "lorebook": "- Lorebook (N entries):",
}
COMPACT_LABELS = {
    "tags": "Tags: ", "description": "Desc: ", "personality": "Personality: ", "scenario": "Scenario: ", "first_mes": "Greeting: ",
    "mes_example": "Example: ", "creator_notes": "Notes: ", "alt_greetings": "AltGreetings (N):", "lorebook": "Lorebook (N):",
    "system_prompt": "System: ", "post_history_instructions": "PostHistory: ",
}


def extra_fields(value) -> frozenset[str]:
    """Optional fields from a list or comma-separated text; None is the default, "all" all, empty or "none" none; unknown names go."""
    if value is None:
        return DEFAULT_EXTRA
    names = value.split(",") if isinstance(value, str) else value
    names = {str(x).strip().lower() for x in names} - {""}
    return frozenset(EXTRA_FIELDS) if "all" in names else frozenset(names & set(EXTRA_FIELDS))


def field_caps(value) -> tuple[dict[str, int], list[str]]:
    """Caps by field from a dict or from FIELD=CHARS texts, and what was not understood. Caps of 0 or less are not."""
    pairs = value.items() if isinstance(value, dict) else [str(x).partition("=")[::2] for x in value or ()]
    good, bad = {}, []
    for name, number in pairs:
        key = str(name).strip().lower()
        try:
            n = int(str(number).strip())
        except ValueError:
            n = 0
        if key in CAPPABLE and n > 0:
            good[key] = n
        else:
            bad.append(f"{name}={number}")
    return good, bad


def blocks(cards: DataFrame, form: str = "md", *, place: str = "rank", total: Column | None = None, cap: int | None = P.MAX_CHARS, full_top: int = P.FULL_TOP, extra=None, caps: dict[str, int] | None = None) -> DataFrame:
    """ord, place and block of each card; `total` is the number of cards in headings."""
    extra, caps = extra_fields(extra), caps or {}
    tier = tier_cap(c(place), cap, full_top)
    total = F.lit(None).cast("long") if total is None else total
    labels = MD_LABELS if form == "md" else COMPACT_LABELS
    bullet = "  - " if form == "md" else "- "

    def cut(field: str, text: Column) -> Column:
        return X.truncated(X.strip(text), field_cap(tier, caps.get(field)))

    def line(field: str, label: str) -> Column | None:
        if field in EXTRA_FIELDS and field not in extra:
            return None
        if field == "tags":
            return F.when(F.size("tags") > 0, F.concat(F.lit(label), F.array_join("tags", ", ")))
        if field in ("alt_greetings", "lorebook"):
            column = "alternate_greetings" if field == "alt_greetings" else "lorebook_entries"
            head, _, tail = label.partition("N")
            if field == "alt_greetings":
                items = F.transform(column, lambda g: F.concat(F.lit(bullet), cut(field, g)))
            else:
                items = F.transform(column, lambda e: F.concat(F.lit(f"{bullet}["), F.array_join(e["keys"], ", "), F.lit("] "), cut(field, e["content"])))
            return F.when(F.size(column) > 0, F.concat_ws("\n", F.concat(F.lit(head), F.size(column).cast("string"), F.lit(tail)), F.array_join(items, "\n")))
        return F.when(c(field) != "", F.concat(F.lit(label), cut(field, c(field))))

    name = X.title(c("name"), c("nickname"))
    at = F.concat(c(place).cast("string"), F.lit("/"), total.cast("string"))
    if form == "md":
        head = [F.concat(F.lit("## Card "), at, F.lit(": "), name), F.concat(F.lit("- (file: "), X.basename(c("source_file")), F.lit(")"))]
    else:
        head = [F.concat(F.lit("=== CARD "), at, F.lit(" ===")), F.concat(F.lit("Name: "), name)]
    lines = [x for f, label in labels.items() if (x := line(f, label)) is not None]
    return cards.select("ord", c(place), F.concat_ws("\n", *head, *lines, F.lit("")).alias("block"))


def as_dict(cards: DataFrame, *, place: str | None = None, cap: int | None = None, full_top: int = 0, extra=EXTRA_FIELDS, caps: dict[str, int] | None = None) -> DataFrame:
    """ord and json: each card in the engine's own form. Keys keep their types whatever is cut."""
    extra, caps = extra_fields(extra), caps or {}
    tier = tier_cap(c(place), cap, full_top) if place else F.lit(cap).cast("int")
    have = set(cards.columns)

    def text(name: str, field: str | None = None) -> Column:
        value = c(name) if name in have else F.lit("")
        return (X.truncated(X.strip(value), field_cap(tier, caps.get(field))) if field else value).alias(name)

    none = F.array().cast("array<string>")
    plain = [text(n) for n in ("name", "nickname", "character_version")]
    cutted = [text(n, n) for n in ("description", "personality", "scenario", "first_mes", "mes_example")]
    tail = [(c("source") if "source" in have and dict(cards.dtypes)["source"].startswith("array") else none).alias("source"), text("spec_version"), text("source_keyword"), text("source_file"), c("bloat_chars_removed")]
    more = [c("tags")] if "tags" in extra else []
    more += [text(n, n) for n in ("creator_notes", "system_prompt", "post_history_instructions") if n in extra]
    if "alt_greetings" in extra:
        more.append(F.transform("alternate_greetings", lambda g: X.truncated(X.strip(g), field_cap(tier, caps.get("alt_greetings")))).alias("alternate_greetings"))
    if "lorebook" in extra:
        more.append(F.transform("lorebook_entries", lambda e: F.struct(e["keys"].alias("keys"), X.truncated(X.strip(e["content"]), field_cap(tier, caps.get("lorebook"))).alias("content"), e["comment"].alias("comment"))).alias("lorebook_entries"))
    return cards.select("ord", *([c(place)] if place else []), F.to_json(F.struct(*plain, *cutted, *tail, *more)).alias("json"))
