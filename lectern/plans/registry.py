"""All queries of the library by name, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.schema import ALIASES, LISTS
from ..operators import aggregate as A
from ..operators import features as D
from ..operators import render as K
from ..operators import select as R
from ..operators import tokens as T
from ..sources import adapter, png
from ..sources import cards as S
from . import guidance as G
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
c = F.col


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _features(spark: SparkSession, d: str) -> DataFrame:
    return D.features(adapter.cards(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return R.scored(_features(spark, d))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their rank and the number of cards. Only ids and scores are ranked; whole texts meet their ranks in one join."""
    from .session import cut

    ranks = cut(R.rank_cards(_scored(spark, d)).select("ord", "rank"))
    return adapter.cards(spark, d).join(ranks, "ord").withColumn("total", F.lit(ranks.count()))


# --- cleaning ---------------------------------------------------------------------------------------------------
def _step(column: str, table: str, key: str, name: str) -> None:
    pattern, new = next(((p, r) for n, p, r in X.STEPS if n == name), (P.LINE_ENDING, "\n"))

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = adapter.base(spark, d) if table == "base" else _table(spark, d, table)
        return rows.select(c(key).alias("id"), F.regexp_replace(F.coalesce(c(column), F.lit("")), pattern, new).alias("text"))

    source = f"({O.BASE})" if table == "base" else table
    at = f"coalesce({column}, '')"
    named = {"newlines": "clean_newlines", "spaces": "collapse_spaces", "blank_lines": "collapse_blank_lines"}.get(name, f"strip_{name}")
    _add(named, query, f"select {key} as id, {O.step(name, at)} as text from {source}")


for _name in ("newlines", "data_uri", "md_images", "emoji_codes", "decorative_lines", "spaces", "blank_lines"):
    _step("raw_description", "base", "ord", _name)
for _name in ("html_comments", "html_tags"):
    _step("html", "pages", "page_id", _name)


def _clean_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "pages").select(c("page_id").alias("id"), c("html").alias("before"), X.cleaned(c("html")).alias("text"))
    return rows.select("id", "text", X.removed(c("before"), c("text")).alias("removed"))


def _clean_sql(table: str, key: str, column: str) -> str:
    at, cols = f"coalesce({column}, '')", []
    for i, name in enumerate(O.STEPS):
        cols.append(f"{O.step(name, at)} as t{i}")
        at = f"t{i}"
    return f"select id, t9 as text, greatest(0, length(t0) - length(t9))::bigint as removed from (select {key} as id, {', '.join(cols)} from {table})"


_add("clean_text", _clean_text, _clean_sql("pages", "page_id", "html"))
_add("card_bloat_removed", lambda s, d: adapter.cards(s, d).select("ord", "description", "bloat_chars_removed"), O.with_cards("select ord, description, bloat_chars_removed from cards"))

# --- detectors: a flag or count for every card --------------------------------------------------------------------
_FLAGS = {
    "conv_char_placeholder": "char_placeholder", "conv_user_placeholder": "user_placeholder", "conv_start_marker": "start_marker", "conv_asterisk": "asterisk",
    "conv_quoted": "quoted", "conv_backtick": "backtick", "conv_turn_lines": "turns", "conv_plus_bullet": "plus_bullet", "conv_xml_block": "xml_block",
    "conv_npc_block": "npc_block", "multi_character": "multi_character", "conv_instructions": "instructions", "conv_status_line": "status_line",
    "conv_opens_action": "opens_action", "conv_ends_speech": "ends_speech", "first_mes_paragraphs": "paragraphs",
}
for _key, _column in _FLAGS.items():
    _add(_key, lambda s, d, x=_column: _features(s, d).select("ord", c(x).alias("value")), O.with_cards(f"select ord, {_column} as value from feats"))
_add(
    "conv_per_character_blocks",
    lambda s, d: _features(s, d).select("ord", F.array_join(F.array_sort("named_blocks"), ",").alias("names"), (F.size("named_blocks") >= 2).alias("value")),
    O.with_cards("select ord, array_to_string(list_sort(named_blocks), ',') as names, len(named_blocks) >= 2 as value from feats"),
)
_add(
    "section_headers",
    lambda s, d: _features(s, d).select("ord", F.posexplode(F.arrays_zip("section_markers", "section_names")).alias("i", "h")).select("ord", c("i").cast("long").alias("i"), c("h.section_markers").alias("marker"), c("h.section_names").alias("name")),
    O.with_cards("select ord, (i - 1)::bigint as i, section_markers[i] as marker, section_names[i] as name from (select ord, section_markers, section_names, unnest(range(1, len(section_names) + 1)) as i from feats)"),
)
_add(
    "presence_masks",
    lambda s, d: _features(s, d).select("ord", "has_example", "has_first_mes", "has_description", "has_scenario"),
    O.with_cards("select ord, has_example, has_first_mes, has_description, has_scenario from feats"),
)

# --- aggregates -----------------------------------------------------------------------------------------------------
_add("conv_summary", lambda s, d: A.conv_summary(_features(s, d)), O.with_cards(O.SUMMARY))
_add(
    "field_coverage",
    lambda s, d: A.field_coverage(_features(s, d)),
    O.with_cards(" union all ".join([f"select '{f}' as field, {O.count(O.present(f))} as cards from feats" for f in D.CORE] + [f"select 'tags', {O.count('len(tags) > 0')} from feats"])),
)
_add("median_turns", lambda s, d: A.conv_summary(_features(s, d)).select("median_example_turns"), O.with_cards(f"select median_example_turns from ({O.SUMMARY})"))
_add("median_paragraphs", lambda s, d: A.conv_summary(_features(s, d)).select("median_first_mes_paragraphs"), O.with_cards(f"select median_first_mes_paragraphs from ({O.SUMMARY})"))
_add("median_description", lambda s, d: A.conv_summary(_features(s, d)).select("median_description_chars"), O.with_cards(f"select median_description_chars from ({O.SUMMARY})"))
_STYLES = " union all ".join(f"select '{x}' as section_style, {O.count(f'section_style = {chr(39)}{x}{chr(39)}')} as cards, {i} as i from feats" for i, x in enumerate(P.SECTION_STYLES))
_add("section_style_counts", lambda s, d: A.section_style_counts(_features(s, d)), O.with_cards(f"select section_style, cards from ({_STYLES})"))
_add("dominant_style", lambda s, d: A.dominant_style(_features(s, d)), O.with_cards(f"select section_style, cards from ({_STYLES}) order by cards desc, i limit 1"))
_add(
    "section_names",
    lambda s, d: A.section_names(_features(s, d)),
    O.with_cards(f"""select name, cards, round(position, 6) as position, row_number() over (order by position, o, i)::bigint as place from (
      select name, count(*)::bigint as cards, avg(rel) as position, min((ord, i)) as seen, seen[1] as o, seen[2] as i from (
        select ord, {O.strip('section_names[i]')} as name, (i - 1) / greatest(1, len(section_names) - 1) as rel, i, row_number() over (partition by ord, lower({O.strip('section_names[i]')}) order by i) as nth
        from (select ord, section_names, unnest(range(1, len(section_names) + 1)) as i from feats where has_description and sections)) where nth = 1 group by name)
      where cards >= 0.25 * (select count(*) from feats where has_description and sections) and cards >= 3"""),
)
_STATS = f"""select count(*)::bigint as count, {O.count('multi_character')} as multi_character_cards, {O.count('not multi_character')} as single_character_cards,
 coalesce(round_even(avg(description_chars) filter (description <> ''), 0), 0)::bigint as avg_description_chars, coalesce(min(description_chars) filter (description <> ''), 0)::bigint as min_description_chars,
 coalesce(max(description_chars) filter (description <> ''), 0)::bigint as max_description_chars, {O.count("description = ''")} as cards_missing_description,
 coalesce(sum(bloat_chars_removed), 0)::bigint as total_bloat_chars_removed, {O.count('bloat_chars_removed > 0')} as cards_with_bloat from feats"""
_add("corpus_stats", lambda s, d: A.corpus_stats(_features(s, d)), O.with_cards(_STATS))
_add(
    "description_lengths",
    lambda s, d: A.corpus_stats(_features(s, d)).select("avg_description_chars", "min_description_chars", "max_description_chars"),
    O.with_cards(f"select avg_description_chars, min_description_chars, max_description_chars from ({_STATS})"),
)
_add("bloat_totals", lambda s, d: A.corpus_stats(_features(s, d)).select("total_bloat_chars_removed", "cards_with_bloat"), O.with_cards(f"select total_bloat_chars_removed, cards_with_bloat from ({_STATS})"))
_add(
    "top_tags",
    lambda s, d: A.top_tags(adapter.cards(s, d)),
    O.with_cards("select tag, count(*)::bigint as cards from (select ord, i, lower(trim(tags[i])) as tag from (select ord, tags, unnest(range(1, len(tags) + 1)) as i from cards)) where tag <> '' group by tag order by cards desc, min((ord, i)) limit 20"),
)
_add("spec_versions", lambda s, d: A.spec_versions(adapter.cards(s, d)), O.with_cards("select spec_version, count(*)::bigint as cards from cards group by 1"))
_add("top_bloat", lambda s, d: A.top_bloat(adapter.cards(s, d)), O.with_cards(f"select {O.TITLE} as card, bloat_chars_removed from cards where bloat_chars_removed > 0 order by bloat_chars_removed desc, ord limit 3"))
_SHARES = " union all ".join(f"select '{k}' as convention, {k} as n, {v} as total from s" for k, v in A.SHARES.items())
_SHARE_SQL = f"""with {O.CARDS}, s as ({O.SUMMARY}) select convention, n, total, case when total > 0 then {O.half_even('100 * n', 'total')} else 0 end as pct, total >= 3 and 2 * n >= total as dominant,
      total >= 3 and (4 * n >= total or n >= 5) as common, total > 0 and 5 * n >= 4 * total as universal from ({_SHARES})"""
_add("convention_shares", lambda s, d: A.convention_shares(A.conv_summary(_features(s, d))), _SHARE_SQL)
_add("share_texts", lambda s, d: A.share_texts(A.convention_shares(A.conv_summary(_features(s, d)))), f"select convention, format('{{:,}} of {{:,}} cards ({{}}%)', n, total, pct) as share from ({_SHARE_SQL})")
_add("truncation_ratio", lambda s, d: A.truncation_ratio(adapter.cards(s, d)), O.with_cards("select sum(least(length(description), 600))::bigint as shown, sum(length(description))::bigint as actual from cards"))

# --- scores, ranks, selections --------------------------------------------------------------------------------------
_add("score_cards", lambda s, d: _scored(s, d).select("ord", "score"), O.with_scores("select ord, score from scored"))
_add("rank_cards", lambda s, d: R.rank_cards(_scored(s, d)).select("ord", "score", "rank"), O.with_scores("select ord, score, rank from ranked"))
_by_name = lambda: F.lower(F.coalesce(F.nullif("name", F.lit("")), c("nickname")))
_add(
    "sort_by_name",
    lambda s, d: R.numbered(adapter.cards(s, d).select("ord", "name", "nickname"), [_by_name(), F.asc("ord")], "place").select("ord", "place"),
    O.with_cards("select ord, row_number() over (order by lower(coalesce(nullif(name, ''), nickname)), ord)::bigint as place from cards"),
)
_add(
    "sort_by_file",
    lambda s, d: R.numbered(adapter.cards(s, d).select("ord", "source_file"), [F.asc("source_file"), F.asc("ord")], "place").select("ord", "place"),
    O.with_cards("select ord, row_number() over (order by source_file, ord)::bigint as place from cards"),
)
_add("select_best", lambda s, d: R.select_best(_scored(s, d), 25).select("ord", "name", "score"), O.with_scores("select ord, name, score from ranked where rank <= 25"))
_add(
    "exemplars",
    lambda s, d: R.exemplars(_scored(s, d)),
    O.with_scores("select ord, trim(coalesce(nullif(name, ''), nickname)) as name, score from ranked where rank <= 3 and trim(coalesce(nullif(name, ''), nickname)) <> '' and score > 0"),
)


def _pins(spark: SparkSession, d: str) -> DataFrame:
    ranked = R.rank_cards(_scored(spark, d), "source_file")
    pinned = adapter.base(spark, d).where("ord % 97 = 5").select("source_file")
    return R.apply_pins(ranked.select("ord", "source_file", "rank"), pinned).select("ord", "pinned", "place")


def _without(spark: SparkSession, d: str) -> DataFrame:
    removed = adapter.base(spark, d).where("ord % 7 = 3").select("source_file")
    return R.without(adapter.cards(spark, d), removed).select("ord", "source_file")


_add("remove_cards", _without, O.with_cards("select ord, source_file from cards where ord % 7 <> 3"))
_add("apply_pins", _pins, O.with_scores("select ord, ord % 97 = 5 as pinned, row_number() over (order by ord % 97 = 5 desc, rank)::bigint as place from ranked"))
_add(
    "agreeing_prefix",
    lambda s, d: R.structure_consistency(_scored(s, d)),
    O.with_scores("""select count(*)::bigint as cards, sum(flag)::bigint as structured, coalesce(max(case when 10 * cum >= 8 * n then n end), 0)::bigint as agreeing_prefix, count(*) >= 20 as stable
      from (select flag, sum(flag) over w as cum, row_number() over w as n from (select rank, case when sections then 1 else 0 end as flag from ranked where has_description) window w as (order by rank rows unbounded preceding))"""),
)
_add("depth_tier", lambda s, d: R.rank_cards(_scored(s, d)).select("ord", "rank", F.coalesce(R.tier_cap(c("rank"), P.MAX_CHARS), F.lit(-1)).cast("long").alias("cap")), O.with_scores("select ord, rank, (case when rank > 10 then 600 else -1 end)::bigint as cap from ranked"))
_CAPS = {"first_mes": 1200, "description": 300, "scenario": None}
_add(
    "field_caps",
    lambda s, d: R.rank_cards(_scored(s, d)).select("ord", *(F.coalesce(R.field_cap(R.tier_cap(c("rank"), P.MAX_CHARS), n), F.lit(-1)).cast("long").alias(f) for f, n in _CAPS.items())),
    O.with_scores("select ord, least(case when rank > 10 then 600 end, 1200)::bigint as first_mes, least(case when rank > 10 then 600 end, 300)::bigint as description, (case when rank > 10 then 600 else -1 end)::bigint as scenario from ranked"),
)

# --- text functions, tokens, blocks ----------------------------------------------------------------------------------
_add(
    "truncate_fields",
    lambda s, d: adapter.cards(s, d).select("ord", *(X.truncated(c(f), F.lit(n)).alias(f) for f, n in (("description", 120), ("first_mes", 30), ("scenario", 600)))),
    O.with_cards(f"select ord, {O.truncated('description', '120')} as description, {O.truncated('first_mes', '30')} as first_mes, {O.truncated('scenario', '600')} as scenario from cards"),
)
_add("basename", lambda s, d: adapter.base(s, d).select("ord", X.basename(c("source_file")).alias("file")), f"select ord, string_split(source_file, '/')[-1] as file from ({O.BASE})")
_add("card_title", lambda s, d: adapter.base(s, d).select("ord", X.title(c("name"), c("nickname")).alias("title")), f"select ord, {O.TITLE} as title from ({O.BASE})")
_add("token_heuristic", lambda s, d: _table(s, d, "documents").select("doc_id", X.token_heuristic(c("text")).alias("tokens")), f"select doc_id, {O.tokens('text')} as tokens from documents")
_add(
    "token_counts",
    lambda s, d: adapter.cards(s, d).select("ord", X.token_heuristic(c("description")).alias("description"), X.token_heuristic(c("first_mes")).alias("first_mes"), X.token_heuristic(c("mes_example")).alias("mes_example")),
    O.with_cards(f"select ord, {O.tokens('description')} as description, {O.tokens('first_mes')} as first_mes, {O.tokens('mes_example')} as mes_example from cards"),
)


def _exact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by the tokenizers library, from a file at hand; without the files' package all counts are the heuristic."""
    try:
        from public_tokenizers import path
    except ImportError:
        return _table(spark, d, "documents").select("doc_id", T.tokens_of(F.coalesce("text", F.lit(""))).alias("tokens"))
    return _table(spark, d, "documents").select("doc_id", T.tokens_of(F.coalesce("text", F.lit("")), path("byte_bpe_50k.json")).alias("tokens"))


_add("token_counts_exact", _exact_counts)
for _form, _block in (("md", O.MD_BLOCK), ("compact", O.COMPACT_BLOCK)):
    _add(
        f"render_{_form}_blocks",
        lambda s, d, x=_form: K.blocks(_ranked(s, d), x, total=c("total"), extra="all").select("ord", "rank", "block"),
        O.with_scores(f"select ord, rank, concat_ws(chr(10), {_block}) as block from ranked"),
    )
_add(
    "estimate_per_card",
    lambda s, d: K.blocks(_ranked(s, d), "md", total=c("total"), extra="all").select("ord", "rank", X.token_heuristic(c("block")).alias("tokens")),
    O.with_scores(f"select ord, rank, {O.tokens('block')} as tokens from (select ord, rank, concat_ws(chr(10), {O.MD_BLOCK}) as block from ranked)"),
)
_add("cards_json", lambda s, d: K.as_dict(_ranked(s, d), place="rank", cap=P.MAX_CHARS, full_top=P.FULL_TOP), O.with_scores(f"select ord, rank, {O.CARD_JSON} as json from ranked"))
_TRIP = ", ".join(f"{O.ROUNDTRIP.get(x, x)} as {x}" for x in (*ALIASES, "lorebook_entries"))
_add("json_cards_roundtrip", lambda s, d: _flat(S.from_json(K.as_dict(adapter.cards(s, d))).drop("ord")), O.with_cards(f"select {_TRIP}, spec_version, '' as source_keyword, source_file, bloat_chars_removed from cards"))

# --- lines of guidance, from the aggregates -------------------------------------------------------------------------------
def _lines(make: Callable) -> Query:
    """Rows (i, line) of what `make` says of the card view's corpus."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        from . import api
        from .session import cut

        found = make(api.corpus(cut(_scored(spark, d))))  # nine aggregates read it
        return spark.createDataFrame(list(enumerate(found)), "i long, line string")

    return query


def _lines_sql(tables: str, lines: list[str], source: str) -> str:
    """The lines that are not null, as rows (i, line); each is SQL over one row of `source`."""
    return f"with {tables}, l as (select list_filter([{', '.join(lines)}], lambda x: x is not null) as l from {source}) select (i - 1)::bigint as i, l[i] as line from (select l, unnest(range(1, len(l) + 1)) as i from l)"


_SUM = f"{O.CARDS}, s as ({O.SUMMARY})"
_COVER = f"{O.CARDS}, c as (select count(*)::bigint as total, {', '.join(f'{O.count(O.present(f))} as {f}' for f in D.CORE)}, {O.count('len(tags) > 0')} as tags from feats)"
_BOTH_SHAPES = "total_cards >= 3 and multi_character_cards not in (0, total_cards)"
_add(
    "guidance_cast",
    _lines(G.cast_note),
    _lines_sql(_SUM, [
        f"case when {_BOTH_SHAPES} then '- Solo cards: ' || (total_cards - multi_character_cards) || '. Group cards: ' || multi_character_cards || '. Write whichever the request calls for.' end",
        f"case when {_BOTH_SHAPES} then '- Length goes with the number of characters, so take it from cards of the same shape.' end",
        f"case when {_BOTH_SHAPES} and per_character_block_cards > 0 then '- Full `<Name>` block for every character: ' || per_character_block_cards || ' of the group cards.' end",
        f"case when {_BOTH_SHAPES} and npc_block_cards > 0 then '- One `<NPCs>` block for the minor figures: ' || npc_block_cards || ' of the group cards.' end",
    ], "s"),
)
_add(
    "guidance_coverage",
    _lines(G.coverage_notes),
    _lines_sql(_COVER, [f"case when total >= 3 and {f} = 0 then '- {label}: empty throughout (0/' || total || '), so these cards teach nothing about it.' end" for f, label in (("personality", "`Personality`"), ("mes_example", "`Example Dialogue`"), ("scenario", "`Scenario`"), ("tags", "Tags"))], "c"),
)
_add("guidance_absent_fields", _lines(G.absent_core_fields), _lines_sql(_COVER, [f"case when total >= 3 and {f} = 0 then '{label}' end" for f, label in G.LABELS.items()], "c"))


def _field_sql(f: str, label: str) -> str:
    known = f"exists (select 1 from feats, unnest(section_names) t(x) where sections and has_description and lower(trim(x)) = '{label.lower()}')"  # a section that any card has
    return (
        f"'{label}: ' || {f} || ' ' || case when total < 3 or {f} = total then '' when {f} = 0 and {known} then 'left empty everywhere, because Description has a section for it' when {f} = 0 then 'left empty everywhere; fill it only if the character needs it' "
        f"when {f} < 0.25 * total then 'rare (' || {f} || '/' || total || '); fill it only if the character needs it' else 'filled in ' || {f} || '/' || total end"
    )


_add(
    "guidance_fields",
    _lines(lambda k: [f"{g['label']}: {g['count']} {g['note']}" for g in G.field_guidance(k)]),
    _lines_sql(_COVER, [_field_sql(f, label) for f, label in G.LABELS.items() if f != "name"], "c"),
)
_AGREEING = """t as (select count(*)::bigint as cards, coalesce(sum(flag), 0)::bigint as structured, coalesce(max(case when 10 * cum >= 8 * n then n end), 0)::bigint as prefix, round(100.0 * sum(flag) / greatest(count(*), 1))::bigint as pct
  from (select flag, sum(flag) over w as cum, row_number() over w as n from (select rank, case when sections then 1 else 0 end as flag from ranked where has_description) window w as (order by rank rows unbounded preceding)))"""
_add(
    "guidance_agreement",
    _lines(lambda k: G.consistency_note(k.consistency)),
    _lines_sql(f"{O.SCORED}, {_AGREEING}", [
        "case when cards between 1 and 19 then 'Too few described cards (' || cards || ', 20 are needed) to trust the section names above.' end",
        "case when cards >= 20 and 10 * structured >= 8 * cards then 'One structure holds for ' || structured || ' of ' || cards || ' described cards (' || pct || '%): follow it.' end",
        "case when cards >= 20 and 10 * structured < 8 * cards then 'The shared structure holds for ' || structured || ' of ' || cards || ' described cards (' || pct || '%), one way of several.' end",
        "case when cards >= 20 and 10 * structured < 8 * cards and prefix >= 20 then 'Among the best ' || prefix || ' at least 80% have it: an export of those alone teaches it better.' end",
    ], "t"),
)
_SPECS = "(select string_agg('v' || spec_version || ' ' || n, ', ' order by spec_version) from (select spec_version, count(*) as n from cards group by 1))"
_TAG_ROWS = "select tag, count(*)::bigint as cards, min((ord, i)) as seen from (select ord, i, lower(trim(tags[i])) as tag from (select ord, tags, unnest(range(1, len(tags) + 1)) as i from cards)) where tag <> '' group by tag"
_TAGS_SQL = "(select string_agg(tag || ' ' || cards, ', ' order by cards desc, seen) from (select * from ({}) order by cards desc, seen limit {}))"
_TOKENS = "round_even(total_bloat_chars_removed / 4, 0)::bigint"
_HEAVY = f"(select string_agg(card || ' (' || format('{{:,}}', bloat_chars_removed) || ')', ', ' order by bloat_chars_removed desc, ord) from (select {O.TITLE} as card, ord, bloat_chars_removed from cards where bloat_chars_removed > 0 order by bloat_chars_removed desc, ord limit 3))"
_MIXED = "multi_character_cards > 0 and single_character_cards > 0"
_LENGTHS = "min_description_chars || ' to ' || max_description_chars"
_add(
    "guidance_stats",
    _lines(lambda k: G.stats_block(k).split("\n")),
    _lines_sql(f"{O.CARDS}, t as ({_STATS})", [
        "'- Number of cards: ' || count", f"case when {_MIXED} then '- Solo: ' || single_character_cards || ', group: ' || multi_character_cards end", f"'- Card versions: ' || {_SPECS}", f"'- Most used tags: ' || {_TAGS_SQL.format(_TAG_ROWS, 20)}",
        f"case when max_description_chars > 0 then '- Description, in characters: ' || {_LENGTHS} || ', mean ' || avg_description_chars end", "case when cards_missing_description > 0 then '- Without a description: ' || cards_missing_description end",
        f"case when total_bloat_chars_removed > 0 then '- Markup removed before export: ' || format('{{:,}}', total_bloat_chars_removed) || ' characters, about ' || format('{{:,}}', {_TOKENS}) || ' tokens, in ' || cards_with_bloat || ' of the cards' end",
        f"case when total_bloat_chars_removed > 0 then '  Most of it in ' || {_HEAVY} end",
    ], "t"),
)
_add(
    "guidance_stats_compact",
    _lines(lambda k: G.stats_block(k, compact=True).split(" | ")),
    _lines_sql(f"{O.CARDS}, t as ({_STATS})", [
        "'cards ' || count", f"case when {_MIXED} then 'solo ' || single_character_cards || ', group ' || multi_character_cards end", f"'versions ' || {_SPECS}", f"'tags ' || {_TAGS_SQL.format(_TAG_ROWS, 10)}",
        f"case when max_description_chars > 0 then 'description ' || {_LENGTHS} || ' chars, mean ' || avg_description_chars end",
        f"case when total_bloat_chars_removed > 0 then 'markup removed ' || total_bloat_chars_removed || ' chars (~' || {_TOKENS} || ' tokens) in ' || cards_with_bloat end",
    ], "t"),
)
_add("guidance_style", _lines(G.convention_lines))
_add("guidance_template", _lines(lambda k: G.template(k).split("\n")))


def _warning(spark: SparkSession, d: str) -> DataFrame:
    """What is said of a document of all texts' tokens."""
    r = _table(spark, d, "documents").agg(F.sum(X.token_heuristic(c("text"))).alias("tokens"), F.count("*").alias("cards")).first()
    return spark.createDataFrame(list(enumerate(G.context_warning(r["tokens"], r["cards"]))), "i long, line string")


_add(
    "context_warning",
    _warning,
    _lines_sql(f"t as (select sum({O.tokens('text')})::bigint as tokens, count(*)::bigint as cards from documents)", [
        "case when tokens > 128000 then format('Long export: {:,} tokens, {:.1f} times a context of 128,000. What shortens it:', tokens, tokens / 128000.0) end",
        "case when tokens > 128000 then '    --full-top 15    15 cards complete, the others cut at --max-chars' end",
        "case when tokens > 128000 and cards > 40 then '    --best 40        40 of the ' || cards || ' cards' end",
    ], "t"),
)

# --- payloads ----------------------------------------------------------------------------------------------------------
#: Chunks of three keywords' worth for each document, with its whole text (jtext: as JSON), as SQL for both engines; the third
#: repeats the first's keyword.
_CHUNKS = """
select doc_id as ord, 0 as ordinal, 'chara' as keyword, '{"name":"First ' || cast(doc_id as STR) || '","description":' || jtext || '}' as text from DOCUMENTS
union all select doc_id, 1, 'ccv3', case doc_id % 5 when 0 then '' when 1 then 'not json' when 2 then '{"spec":"chara_card_v3","data":{}}'
  when 3 then '{"spec":"chara_card_v3","spec_version":"3.1","data":{"name":"Three ' || cast(doc_id as STR) || '","greeting":' || jtext || ',"first_mes":"","nickname":null,"alternate_greetings":["Hi  there",5,"",true],"character_book":{"entries":[{"key":"k","content":' || jtext || '},7]}}}'
  else '{"spec":"chara_card_v3","data":{"name":"","description":' || jtext || ',"source":["' || source || '"],"tags":["' || lang || '",1.5,null],"creator":7}}' end from DOCUMENTS
union all select doc_id, 2, 'chara', case when doc_id % 2 = 0 then '{"spec":"chara_card_v2","data":{"name":"Two ' || cast(doc_id as STR) || '","creatorcomment":"c","tags":"one","mes_example":' || jtext || '}}' when doc_id % 7 = 1 then '[]'
  else '{"name":"One ' || cast(doc_id as STR) || '","example_dialogue":' || jtext || ',"greeting":"Hello <b>you</b>","scenario":5,"personality":false}' end from DOCUMENTS
"""


def _json_text(text: Column) -> Column:
    """A text as JSON, quotes included: the value of {"v":...}."""
    return S.let(F.to_json(F.struct(text.alias("v"))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    sql = _CHUNKS.replace("STR)", "string)").replace("{", "{{").replace("}", "}}").replace("DOCUMENTS", "{documents}")
    rows = _table(spark, d, "documents").select("doc_id", *(F.coalesce(x, F.lit("")).alias(x) for x in ("lang", "source")), _json_text(F.coalesce("text", F.lit(""))).alias("jtext"))
    return spark.sql(sql, documents=rows)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The chunks as files: path, chunks, error; base64 for every third document."""
    rows = _chunks(spark, d)
    text = F.when(c("ord") % 3 == 0, F.base64(F.encode("text", "UTF-8"))).otherwise(c("text"))
    one = F.struct(c("ordinal").cast("int").alias("ordinal"), "keyword", text.alias("text"), F.lit("tEXt").alias("chunk_type"))
    return rows.groupBy(c("ord").alias("path")).agg(F.array_sort(F.collect_list(one)).alias("chunks")).withColumn("error", F.lit(None).cast("string"))  # three chunks a file


_CHUNK_SQL = _CHUNKS.replace("STR)", "varchar)").replace("DOCUMENTS", "(select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, to_json(coalesce(text, ''))::varchar as jtext from documents)")
_LAST = f"with chunks as ({_CHUNK_SQL}), last as (select ord, keyword, arg_max(text, ordinal) as text from chunks group by 1, 2)"
_PARSED = f"{_LAST}, {O.parsed('last')}"
_add(
    "chunk_last_wins",
    lambda s, d: _chunks(s, d).groupBy("ord", "keyword").agg(F.max_by("text", "ordinal").alias("text")),
    f"{_LAST} select ord, keyword, text from last",
)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return S.parse(_files(spark, d)).select(c("path").alias("ord"), "card", "error")


def _of_card(*columns: str) -> Query:
    return lambda s, d: _parsed(s, d).where("card is not null").select("ord", *(c(f"card.{x}").alias(x) for x in columns))


def _flat(cards: DataFrame) -> DataFrame:
    """Cards with their lists as JSON, which both engines write alike."""
    return cards.select(*(F.to_json(x).alias(x) if t.startswith("array") else c(x) for x, t in cards.dtypes))


_JOINED = ", ".join(f"array_to_string({x}, '|') as {x}" for x in LISTS)
_NORMAL = ", ".join(f"to_json({x})::varchar as {x}" if x in LISTS else x for x in ALIASES)
_add("prefer_v3", _of_card("source_keyword", "name"), f"{_PARSED} select ord, keyword as source_keyword, name from card")
_add("spec_version_detect", _of_card("spec_version"), f"{_PARSED} select ord, spec_version from card")
_add("alias_coalesce", _of_card("first_mes", "mes_example", "creator_notes"), f"{_PARSED} select ord, first_mes, mes_example, creator_notes from card")
_add("non_empty_cards", _of_card("name", "description"), f"{_PARSED} select ord, name, description from card")
_add("coerce_list", lambda s, d: _parsed(s, d).where("card is not null").select("ord", *(F.array_join(f"card.{x}", "|").alias(x) for x in LISTS)), f"{_PARSED} select ord, {_JOINED} from card")
_add("extraction_failures", lambda s, d: _parsed(s, d).where("card is null").select("ord", c("error").alias("reason")), f"{_PARSED} select ord, '{S.NO_CARD}' as reason from (select distinct ord from chunks) where ord not in (select ord from card)")
_add(
    "normalized_cards",
    lambda s, d: _flat(_parsed(s, d).where("card is not null").select("ord", "card.*")),
    f"{_PARSED} select ord, {_NORMAL}, to_json(lorebook_entries)::varchar as lorebook_entries, spec_version, keyword as source_keyword, bloat_chars_removed from card",
)
_add(
    "decode_payload",
    lambda s, d: _files(s, d).select(c("path").alias("ord"), F.explode("chunks").alias("k")).select("ord", c("k.ordinal").cast("long").alias("ordinal"), S.decoded(c("k.text")).isNotNull().alias("valid")),
    f"with chunks as ({_CHUNK_SQL}) select ord, ordinal::bigint as ordinal, json_valid(text) and text <> '' as valid from chunks",
)
_BOOK = """'{"name":"B","character_book":{"entries":[{"keys":["' || lang || '","' || source || '"],"content":' || jtext || '},5,{"key":"solo","content":"one  two","comment":"n"},{"content":"bare"}]}}'"""


def _lorebook(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").withColumn("jtext", _json_text(F.coalesce("text", F.lit("")))).select(c("doc_id").alias("ord"), F.try_parse_json(F.expr(_BOOK)).alias("data"))
    book = rows.select("ord", F.posexplode(S.lorebook(c("data"))).alias("i", "e"))
    return book.select("ord", c("i").cast("long").alias("i"), F.array_join("e.keys", "|").alias("keys"), X.cleaned(c("e.content")).alias("content"), c("e.comment").alias("comment"))


_add(
    "lorebook_explode",
    _lorebook,
    f"""with d as (select doc_id as ord, ({_BOOK})::json as data from (select *, to_json(coalesce(text, ''))::varchar as jtext from documents)), e as (select ord, {O.lorebook('data')} as book from d)
      select ord, (i - 1)::bigint as i, array_to_string(book[i].keys, '|') as keys, book[i].content as content, book[i].comment as comment from (select ord, book, unnest(range(1, len(book) + 1)) as i from e)""",
)


def _png_file(number: int, text: str) -> bytes:
    """A PNG file as input: a tEXt, a zTXt and an iTXt chunk (compressed for odd numbers) of the text, then IEND."""
    if number % 50 == 0:
        return b"GIF89a"
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw, packed = text.encode(), number % 2
    plain = base64.b64encode(raw)
    return b"".join([
        png.SIGNATURE, chunk(b"tEXt", b"chara\0" + plain), chunk(b"zTXt", b"ccv3\0\0" + zlib.compress(plain)),
        chunk(b"iTXt", b"Comment\0" + bytes([packed, 0]) + b"en\0note\0" + (zlib.compress(raw) if packed else raw)), chunk(b"IEND", b""),
    ])


def _png(spark: SparkSession, d: str) -> DataFrame:
    """Text chunks of PNG bytes made from the documents."""
    made = F.pandas_udf(lambda number, text: pd.Series([_png_file(n, t) for n, t in zip(number, text, strict=True)]), "binary")
    files = _table(spark, d, "documents").select(c("doc_id").cast("string").alias("path"), made("doc_id", F.coalesce("text", F.lit(""))).alias("content"))
    found = png.with_chunks(files)
    return found.select(c("path").cast("long").alias("ord"), F.explode_outer("chunks").alias("k"), "error").select("ord", F.coalesce("k.ordinal", F.lit(-1)).cast("long").alias("ordinal"), c("k.keyword").alias("keyword"), c("k.text").alias("text"), c("k.chunk_type").alias("chunk_type"), "error")


_add(
    "png_text_chunks",
    _png,
    f"""with d as (select doc_id, doc_id % 50 <> 0 as sound, coalesce(text, '') as text from documents), k as (select unnest([0, 1, 2]) as i)
      select doc_id as ord, case when sound then i::bigint else -1 end as ordinal, case when sound then ['chara', 'ccv3', 'Comment'][i + 1] end as keyword, case when sound then case when i < 2 then to_base64(encode(text)) else text end end as text,
      case when sound then ['tEXt', 'zTXt', 'iTXt'][i + 1] end as chunk_type, case when not sound then '{png.NOT_A_PNG}' end as error from d, k where sound or i = 0""",
)


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "pages").select((c("page_id") % 7).cast("int").alias("input"), F.concat(F.lit("in/"), F.substring_index("url", "/", 3), F.lit("/x.png")).alias("path"))
    return png.ordered_paths(rows).select("ord", "path")


_add(
    "dedup_paths",
    _dedup,
    """select row_number() over (order by input, string_split(path, '/'))::bigint as ord, path from (
      select 'in/' || array_to_string(string_split(url, '/')[1:3], '/') || '/x.png' as path, min((page_id % 7)::int) as input from pages group by 1)""",
)

