"""A card view of the tables documents and conversations, so that the card operators run on them.

Every card has its document's whole text. The view is one SQL text for both Spark and the tests' database: NL and CR stand for line ends, STR for the text type,
FOLD for the conversations folded to example dialogues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

BASE = """
select doc_id as ord, lang, source,
 case when doc_id % 50 = 49 then '' when doc_id % 9 = 0 then 'Card ' || cast(doc_id as STR) || ' & Co' else 'Card ' || cast(doc_id as STR) end as name,
 case when doc_id % 100 = 49 then 'Nick ' || cast(doc_id as STR) else '' end as nickname,
 case when doc_id % 10 < 3 then '<Name>'||NL||'>Appearance'||NL||'+ '||text||NL||'>Personality'||NL||'+ warm'||NL||'>Backstory'||NL||'+ '||source||NL||'</Name>'
      when doc_id % 10 = 3 then '<Ana>'||CR||NL||'Appearance'||CR||NL||text||'.'||CR||NL||'Backstory'||CR||NL||'far.'||NL||'</Ana>'||NL||'<Bo>'||NL||'Appearance'||NL||'short.'||NL||'</Bo>'
      when doc_id % 10 < 7 then 'Appearance'||NL||text||'.'||NL||'Personality'||NL||lang||' speaker.'||NL||'Backstory'||NL||'from '||source||'.'
      when doc_id % 10 = 7 then 'Alone'||NL||'--------'||NL||text||'.'||NL||'★★★★★'||NL||'end.'
      when doc_id % 10 = 8 then '<b>'||text||'</b><!-- x -->'||NL||NL||NL||NL||'<img src="data:image/png;base64,AAAAAAAAAAAAAAAAAAAAAAAA"> a   b ![p](http://x) <:smile:123>'||NL||'<NPCs>'||NL||'<Mira> hi </Mira>'||NL||'</NPCs>.  '
      when doc_id % 200 = 9 then ''
      else text end as raw_description,
 case when doc_id % 11 = 5 then '*He nods.* He leaves without a word.'
      when doc_id % 7 = 0 then NL||'11:12 PM | August 6 | Rain | Hall'||NL||NL||'*She waits.*'
      when doc_id % 3 = 0 then '*She looks up.* "'||text||'"'
      when doc_id % 3 = 1 then text||NL||NL||'thinks `maybe later`.' else '' end as first_mes,
 case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then '<instructions>stay in role</instructions>' else 'A tavern with {{user}}.' end as scenario,
 case when doc_id % 4 = 1 then lang || ' and calm' else '' end as personality,
 case when doc_id % 5 = 2 then 'Notes from ' || source else '' end as creator_notes,
 case when doc_id % 6 = 1 then 'Stay in role.' else '' end as system_prompt,
 case when doc_id % 3 = 0 then '1.0' when doc_id % 3 = 1 then '2.0' else '3.0' end as spec_version,
 'cards/' || source || '/' || cast(doc_id as STR) || '.png' as source_file,
 text as note, coalesce(c.ex, '') as mes_example
from (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from DOCUMENTS) d left join (FOLD) c on c.conv_id = d.doc_id
"""

FOLD = """select conv_id, '<START>' || NL || AGG as ex from CONVERSATIONS group by conv_id"""
TURN = """(case role when 'user' then '{{user}}: ' when 'assistant' then '{{char}}: ' else '' end || replace(text, NL, ' '))"""


def base_sql(aggregate: str, text_type: str, documents: str = "documents", conversations: str = "conversations") -> str:
    fold = FOLD.replace("AGG", aggregate.replace("TURN", TURN)).replace("CONVERSATIONS", conversations)
    sql = BASE.replace("FOLD", fold).replace("DOCUMENTS", documents)
    return sql.replace("STR)", f"{text_type})").replace("NL", "chr(10)").replace("CR||", "chr(13)||").replace("||CR", "||chr(13)")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view before cleaning."""
    sql = base_sql("listagg(TURN, NL) within group (order by turn)", "string", "documents", "conversations")
    sql = sql.replace("{{", "{{{{").replace("}}", "}}}}").replace("from documents)", "from {documents})").replace("from conversations", "from {conversations} conversations")
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as cards: descriptions cleaned, list fields made."""
    c = F.col
    none = F.array().cast("array<string>")
    raw = base(spark, sf_dir)
    made = raw.withColumns({
        "description": X.cleaned(c("raw_description")),
        "tags": F.array("lang", "source"),
        "alternate_greetings": F.when(c("ord") % 5 == 0, F.array(F.concat(F.lit("Hello from "), "source"))).otherwise(none),
        "lorebook_entries": F.when(c("ord") % 8 == 0, F.array(F.struct(F.array("lang", "source").alias("keys"), c("note").alias("content"), F.lit("").alias("comment")))).otherwise(F.array().cast("array<struct<keys:array<string>,content:string,comment:string>>")),
        "post_history_instructions": F.lit(""),
    })
    return made.withColumn("bloat_chars_removed", X.removed(c("raw_description"), c("description"))).drop("note")
