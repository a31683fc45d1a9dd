"""The queries' SQL for DuckDB, made from shared pieces: the card view, its cleaning, its features."""

from __future__ import annotations

from ..functions.patterns import HTML_TAGS
from ..functions.schema import ALIASES, CLEANED, LISTS
from ..sources.adapter import base_sql

_W = r"[\p{L}\p{N}_]"
_TRIM = "trim(l, ' ' || chr(9))"
HEADER = r"(?m)^[ \t]*(>?)[ \t]*([A-Za-z][A-Za-z0-9 &/''’\-]{2,40})[ \t]*$"

#: One step of cleaning: name, expression over {t}.
STEPS = {
    "newlines": r"regexp_replace({t}, '\r\n?', chr(10), 'g')",
    "data_uri": r"regexp_replace({t}, 'data:[a-zA-Z0-9/+.\-]+;base64,[A-Za-z0-9+/=]{20,}', '', 'g')",
    "html_comments": r"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')",
    "md_images": r"regexp_replace({t}, '!\[[^\]]*\]\([^)]*\)', '', 'g')",
    "emoji_codes": rf"regexp_replace({{t}}, '<a?:{_W}+:[0-9]+>', '', 'g')",
    "html_tags": rf"regexp_replace({{t}}, '(?i)</?(?:{'|'.join(HTML_TAGS)})\b[^<>]*/?>', '', 'g')",
    "decorative_lines": rf"array_to_string(list_transform(string_split({{t}}, chr(10)), lambda l: case when length({_TRIM}) >= 4 and replace({_TRIM}, left({_TRIM}, 1), '') = '' and not regexp_matches(left({_TRIM}, 1), '{_W[:-1]}\s]') then '' else l end), chr(10))",
    "spaces": r"regexp_replace({t}, '[ \t]{2,}', ' ', 'g')",
    "blank_lines": r"regexp_replace({t}, '\n{3,}', chr(10) || chr(10), 'g')",
    "strip": r"regexp_replace(regexp_replace({t}, '^\s+', ''), '\s+$', '')",
}


def step(name: str, t: str) -> str:
    return STEPS[name].replace("{t}", t)


BASE = base_sql("string_agg(TURN, NL order by turn)", "varchar")


def _clean_columns() -> str:
    at, out = "raw_description", []
    for i, name in enumerate(STEPS):
        out.append(f"{step(name, at)} as t{i}")
        at = f"t{i}"
    return ", ".join(out)


def present(x: str) -> str:
    return rf"regexp_matches({x}, '\S')"


CARDS = f"""
base as ({BASE}),
cards as (select * exclude (t0,t1,t2,t3,t4,t5,t6,t7,t8,t9), t9 as description, (length(t0) - length(t9))::bigint as bloat_chars_removed, [lang, source] as tags,
  case when ord % 5 = 0 then ['Hello from ' || source] else [] end as alternate_greetings,
  case when ord % 8 = 0 then [struct_pack(keys := [lang, source], content := note, comment := '')] else [] end as lorebook_entries
  from (select *, {_clean_columns()} from base)),
feats as (select *,
  {present('mes_example')} as has_example, {present('first_mes')} as has_first_mes, {present('description')} as has_description, {present('scenario')} as has_scenario,
  concat_ws(chr(10), description, personality, scenario, first_mes, mes_example) as combined,
  regexp_matches(combined, '(?i)\\{{\\{{char\\}}\\}}') as char_placeholder, regexp_matches(combined, '(?i)\\{{\\{{user\\}}\\}}') as user_placeholder,
  regexp_matches(combined, '`[^`\\n]{{3,}}`') as backtick, regexp_matches(mes_example, '(?i)<START>') as start_marker,
  len(regexp_extract_all(mes_example, '(?mi)^\\s*\\{{\\{{(?:user|char)\\}}\\}}\\s*:'))::bigint as turns,
  regexp_matches(first_mes, '\\*\\S[^*\\n]*\\*') or regexp_matches(mes_example, '\\*\\S[^*\\n]*\\*') as asterisk,
  regexp_matches(first_mes, '["“][^"”\\n]{{3,}}["”]') as quoted,
  regexp_matches(regexp_replace(first_mes, '^\\s+', ''), '^[\\s>#]*\\*\\S') as opens_action,
  regexp_matches(regexp_replace(first_mes, '\\s+$', ''), '["”][\\s*]*$') as ends_speech,
  regexp_matches(coalesce(list_filter(list_transform(string_split(first_mes, chr(10)), lambda l: regexp_replace(regexp_replace(l, '^\\s+', ''), '\\s+$', '')), lambda l: l <> '')[1], ''), '^[^\\n|]{{1,60}}\\|[^\\n|]{{1,60}}\\|[^\\n]{{1,120}}$') as status_line,
  len(list_filter(string_split(first_mes, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S')))::bigint as paragraphs,
  regexp_extract_all(description, '{HEADER}', 1) as hm, regexp_extract_all(description, '{HEADER}', 2) as hn,
  case when len(hn) >= 2 then hm else [] end as section_markers, case when len(hn) >= 2 then hn else [] end as section_names,
  regexp_matches(description, '(?m)^\\+[ \\t]+\\S') as plus_bullet, regexp_matches(description, '<([A-Za-z][A-Za-z0-9_ ]{{0,30}})>') as xml_block,
  regexp_matches(description, '(?i)<NPCs?>') as npc_block,
  list_distinct(list_transform(list_filter(regexp_extract_all(description, '<([A-Za-z][A-Za-z0-9_ ]{{0,30}})>', 1), lambda x: contains(substring(description, strpos(description, '<' || x || '>')), '</' || x || '>')), lambda x: lower(trim(x)))) as named_blocks,
  npc_block or regexp_matches(name, '(?i)\\s(?:&|\\+|and)\\s|,|\\bfamily\\b|\\btwins\\b|\\bsisters\\b|\\bbrothers\\b') as multi_character,
  regexp_matches(scenario, '(?i)<instructions>') as instructions, length(description)::bigint as description_chars,
  len(section_names) > 0 as sections,
  case when len(section_names) > 0 and has_description then (case when 2 * len(list_filter(section_markers, lambda m: m = '>')) >= len(section_markers) then 'marked' else 'bare' end) || '_' || (case when plus_bullet then 'bulleted' else 'plain' end) end as section_style,
  len(list_distinct(list_transform(section_names, lambda x: lower(trim(x))))) as distinct_sections
  from cards)"""


def half_even(n: str, by: str) -> str:
    return f"(({n}) // ({by}) + case when 2 * (({n}) % ({by})) > ({by}) or (2 * (({n}) % ({by})) = ({by}) and (({n}) // ({by})) % 2 = 1) then 1 else 0 end)::bigint"


_SCORE = f"""(least(distinct_sections, 8) * 6000 + case when plus_bullet then 8000 else 0 end + case when xml_block then 6000 else 0 end + least(description_chars, 12000)
 + least(2 * length(first_mes), 8000) + case when has_scenario then 5000 else 0 end + case when has_example then 4000 else 0 end + case when len(tags) > 0 then 2000 else 0 end
 + case when {present('creator_notes')} then 1000 else 0 end + case when len(alternate_greetings) > 0 then 2000 else 0 end + case when len(lorebook_entries) > 0 then 4000 else 0 end)"""

SCORED = f"""{CARDS},
scored as (select *, {half_even(_SCORE, '10')} as score from feats),
ranked as (select *, row_number() over (order by score desc, lower(name), ord)::bigint as rank, count(*) over ()::bigint as total from scored)"""


def with_cards(select: str) -> str:
    return f"with {CARDS} {select}"


def with_scores(select: str) -> str:
    return f"with {SCORED} {select}"


def median_round(x: str) -> str:
    return f"coalesce(round_even(median({x}), 0), 0)::bigint"


def count(condition: str) -> str:
    return f"count(*) filter ({condition})::bigint"


def truncated(x: str, cap: str) -> str:
    return rf"case when ({cap}) is null or length({x}) <= ({cap}) then {x} else regexp_replace(substring({x}, 1, ({cap})), '\s+$', '') || ' …[truncated]' end"


def strip(x: str) -> str:
    return step("strip", x)


TITLE = "coalesce(nullif(name, ''), nullif(nickname, ''), '(unnamed)')"


def tokens(x: str) -> str:
    words = f"133 * len(regexp_extract_all({x}, '[^\\s]+'))"
    return f"""(case when {x} = '' then 0 else greatest({half_even(words, '100')}, {half_even(f"length({x})", '4')}, case when {present(x)} then 1 else 0 end) end)::bigint"""


SUMMARY = f"""select count(*)::bigint as total_cards, {count('multi_character')} as multi_character_cards, {count('has_example')} as cards_with_example, {count('has_first_mes')} as cards_with_first_mes,
 {count('has_description')} as cards_with_description, {count('has_scenario')} as cards_with_scenario, {count('char_placeholder')} as char_placeholder, {count('user_placeholder')} as user_placeholder,
 {count('has_example and start_marker')} as start_marker, {count('has_example and turns > 0')} as turn_prefixed_example, {median_round('case when has_example and turns > 0 then turns end')} as median_example_turns,
 {count('has_first_mes and asterisk')} as asterisk_action, {count('has_first_mes and quoted')} as quoted_speech, {count('backtick')} as backtick_thoughts,
 {median_round('case when has_first_mes then paragraphs end')} as median_first_mes_paragraphs, {count('has_first_mes and opens_action')} as first_mes_opens_action, {count('has_first_mes and ends_speech')} as first_mes_ends_speech,
 {count('has_first_mes and status_line')} as first_mes_status_line, {count('has_description and sections')} as section_header_cards, {count("has_description and sections and section_style like 'marked%'")} as section_marker_cards,
 {count('has_description and plus_bullet')} as plus_bullet_cards, {count('has_description and xml_block')} as xml_block_cards, {count('has_description and npc_block')} as npc_block_cards,
 {count('has_description and len(named_blocks) >= 2')} as per_character_block_cards, {count('has_scenario and instructions')} as scenario_instructions_cards,
 {median_round('case when has_description then description_chars end')} as median_description_chars from feats"""

_RANK_CAP = "case when rank > 10 then 600 end"


def _cut(x: str) -> str:
    return truncated(f"({strip(x)})", _RANK_CAP)


def _line(label: str, field: str) -> str:
    return f"case when {field} <> '' then '{label}' || {_cut(field)} end"


def _greetings(head: str, bullet: str) -> str:
    a, b = head.split("N", 1)
    return f"case when len(alternate_greetings) > 0 then '{a}' || len(alternate_greetings) || '{b}' || chr(10) || array_to_string(list_transform(alternate_greetings, lambda g: '{bullet}' || {_cut('g')}), chr(10)) end"


def _book(head: str, bullet: str) -> str:
    a, b = head.split("N", 1)
    return f"case when len(lorebook_entries) > 0 then '{a}' || len(lorebook_entries) || '{b}' || chr(10) || array_to_string(list_transform(lorebook_entries, lambda e: '{bullet}[' || array_to_string(e.keys, ', ') || '] ' || {_cut('e.content')}), chr(10)) end"


_TAGS = "case when len(tags) > 0 then '{}' || array_to_string(tags, ', ') end"
MD_BLOCK = ", ".join([
    f"'## Card ' || rank || '/' || total || ': ' || {TITLE}", "'- (file: ' || string_split(source_file, '/')[-1] || ')'", _TAGS.format("- Tags: "),
    *(_line(a, b) for a, b in (("- Description: ", "description"), ("- Personality: ", "personality"), ("- Scenario: ", "scenario"), ("- First message: ", "first_mes"), ("- Example dialogue: ", "mes_example"), ("- Creator notes: ", "creator_notes"))),
    _greetings("- Alt greetings (N):", "  - "), _line("- System prompt: ", "system_prompt"), _book("- Lorebook (N entries):", "  - "), "''",
])
COMPACT_BLOCK = ", ".join([
    "'=== CARD ' || rank || '/' || total || ' ==='", f"'Name: ' || {TITLE}", _TAGS.format("Tags: "),
    *(_line(a, b) for a, b in (("Desc: ", "description"), ("Personality: ", "personality"), ("Scenario: ", "scenario"), ("Greeting: ", "first_mes"), ("Example: ", "mes_example"), ("Notes: ", "creator_notes"))),
    _greetings("AltGreetings (N):", "- "), _book("Lorebook (N):", "- "), _line("System: ", "system_prompt"), "''",
])

# --- cards as JSON, and payloads ---------------------------------------------------------------------------------------


def _capped(x: str) -> str:
    return f"{x} := {_cut(x)}"


CARD_JSON = f"""to_json(struct_pack(name := name, nickname := nickname, character_version := '', {', '.join(map(_capped, ('description', 'personality', 'scenario', 'first_mes', 'mes_example')))}, source := []::varchar[], spec_version := spec_version,
 source_keyword := '', source_file := source_file, bloat_chars_removed := bloat_chars_removed, tags := tags, {', '.join(map(_capped, ('creator_notes', 'system_prompt')))}, post_history_instructions := '',
 alternate_greetings := list_transform(alternate_greetings, lambda g: {_cut('g')}), lorebook_entries := list_transform(lorebook_entries, lambda e: struct_pack(keys := e.keys, content := {_cut('e.content')}, comment := e.comment))))::varchar"""

#: Columns of the round trip that the view has under another form, or not at all.
_JSON_LIST = "to_json({})::varchar"
ROUNDTRIP = {
    "post_history_instructions": "''", "creator": "''", "character_version": "''", "tags": _JSON_LIST.format("tags"), "alternate_greetings": _JSON_LIST.format(f"list_transform(alternate_greetings, lambda g: {strip('g')})"),
    "group_only_greetings": "'[]'", "source": "'[]'", "lorebook_entries": _JSON_LIST.format(f"list_transform(lorebook_entries, lambda e: struct_pack(keys := e.keys, content := {strip('e.content')}, comment := e.comment))"),
    **{x: strip(x) for x in ("description", "personality", "scenario", "first_mes", "mes_example", "creator_notes", "system_prompt")},
}


def cleaned(x: str) -> str:
    for name in STEPS:
        x = step(name, x)
    return x


def _word(e: str) -> str:
    return f"(case json_type({e}) when 'VARCHAR' then ({e})->>'$' when 'BOOLEAN' then upper(left(({e})::varchar, 1)) || substr(({e})::varchar, 2) else ({e})::varchar end)"


def _truthy(e: str) -> str:
    return f"""coalesce(({e})::varchar not in ('""', '0', '0.0', 'false', '[]', '{{}}', 'null'), false)"""


def _list(e: str) -> str:
    return f"coalesce(case json_type({e}) when 'VARCHAR' then [({e})->>'$'] when 'ARRAY' then list_transform(list_filter(({e})::json[], lambda y: {_truthy('y')}), lambda y: {_word('y')}) end, []::varchar[])"


def _given(data: str, names: tuple[str, ...]) -> str:
    """The first of a payload's names whose value is neither null nor empty text."""
    return "coalesce(" + ", ".join(f"""case when ({data}->'$.{n}')::varchar not in ('null', '""') then {data}->'$.{n}' end""" for n in names) + ")"


def _of_entry(name: str) -> str:
    x = f"(e->'$.{name}')"
    return f"coalesce(case when json_type{x} <> 'NULL' then {_word(x)} end, '')"


def lorebook(data: str) -> str:
    keys = "coalesce(" + ", ".join(f"case when {_truthy(x)} then {x} end" for x in ("(e->'$.keys')", "(e->'$.key')")) + ")"
    fields = [f"keys := {_list(keys)}", f"content := {cleaned(_of_entry('content'))}", f"comment := {_of_entry('comment')}"]
    return f"coalesce(list_transform(list_filter(({data}->'$.character_book.entries')::json[], lambda e: json_type(e) = 'OBJECT'), lambda e: struct_pack({', '.join(fields)})), [])"


def parsed(last: str) -> str:
    """Common tables up to `card`: the normalised card of each file, from its last chunk of each keyword."""
    raw = ", ".join(f"{_list(f)} as r_{f}" if f in LISTS else f"coalesce({_word(f)}, '') as r_{f}" for f in ALIASES)
    found = ", ".join(f"{_given('data', names)} as {f}" for f, names in ALIASES.items())
    clean = ", ".join(f"{cleaned(f'r_{f}')} as c_{f}" for f in CLEANED)
    removed = lambda before, after: f"greatest(0, length({step('newlines', before)}) - length({after}))"
    lost = " + ".join(removed(f"r_{f}", f"c_{f}") for f in CLEANED)
    many = f"coalesce(list_sum(list_transform(r_alternate_greetings, lambda g: {removed('g', cleaned('g'))})), 0)"
    content = _of_entry("content")
    books = f"coalesce(list_sum(list_transform(list_filter((data->'$.character_book.entries')::json[], lambda e: json_type(e) = 'OBJECT'), lambda e: {removed(content, cleaned(content))})), 0)"
    columns = [f"c_{f} as {f}" if f in CLEANED else f"list_transform(r_{f}, lambda g: {cleaned('g')}) as {f}" if f == "alternate_greetings" else f"r_{f} as {f}" for f in ALIASES]
    return f"""p as (select ord, keyword, case when json_valid(text) and json_type(text) = 'OBJECT' then text::json end as j from {last}),
 u as (select ord, keyword, j->>'$.spec' as spec, case when spec like 'chara_card%' then j->'$.data' else j end as data,
   case when spec like 'chara_card%' then coalesce(nullif(j->>'$.spec_version', ''), case when spec like '%v3%' then '3.0' else '2.0' end) else '1.0' end as spec_version from p where j is not null),
 g as (select ord, keyword, spec_version, data, {found} from u), r as (select ord, keyword, spec_version, data, {raw} from g), k as (select *, {clean} from r),
 ok as (select *, row_number() over (partition by ord order by keyword) as nth from k where r_name || c_description || c_personality || c_first_mes <> ''),
 card as (select ord, keyword, spec_version, {', '.join(columns)}, {lorebook('data')} as lorebook_entries, ({lost} + {many} + {books})::bigint as bloat_chars_removed from ok where nth = 1)"""
