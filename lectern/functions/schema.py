"""The card record: one row for each character card."""

from __future__ import annotations

from pyspark.sql import types as T

#: Text fields that cleaning applies to.
CLEANED = ("description", "personality", "scenario", "first_mes", "mes_example", "creator_notes", "system_prompt", "post_history_instructions")
#: A field's names in payloads, the first present one counts.
ALIASES = {
    "name": ("name",),
    "nickname": ("nickname",),
    "description": ("description",),
    "personality": ("personality",),
    "scenario": ("scenario",),
    "first_mes": ("first_mes", "greeting"),
    "mes_example": ("mes_example", "example_dialogue"),
    "system_prompt": ("system_prompt",),
    "post_history_instructions": ("post_history_instructions",),
    "creator_notes": ("creator_notes", "creatorcomment"),
    "creator": ("creator",),
    "character_version": ("character_version",),
    "tags": ("tags",),
    "alternate_greetings": ("alternate_greetings",),
    "group_only_greetings": ("group_only_greetings",),
    "source": ("source",),
}
LISTS = ("tags", "alternate_greetings", "group_only_greetings", "source")
#: Payload keywords in order of preference.
KEYWORDS = ("ccv3", "chara")

_text = T.StringType()
_list = T.ArrayType(T.StringType())
LOREBOOK = T.ArrayType(T.StructType([T.StructField("keys", _list), T.StructField("content", _text), T.StructField("comment", _text)]))
CARD = T.StructType(
    [T.StructField("ord", T.LongType())]
    + [T.StructField(k, _list if k in LISTS else _text) for k in ALIASES]
    + [T.StructField("lorebook_entries", LOREBOOK), T.StructField("spec_version", _text), T.StructField("source_keyword", _text), T.StructField("source_file", _text), T.StructField("bloat_chars_removed", T.LongType())]
)
