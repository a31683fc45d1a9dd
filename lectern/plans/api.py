"""The library's façade: extract, export, estimate. Cards stay a DataFrame; only bounded aggregates and the final document
reach the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import aggregate as A
from ..operators import features as D
from ..operators import render as K
from ..operators import select as R
from ..operators import tokens as T
from ..sources import cards as S
from ..sources import png
from . import guidance as G
from .session import cut

FORMATS = ("md", "compact", "json")


@dataclass(frozen=True)
class Options:
    format: str = "md"
    full: bool = False
    max_chars: int | None = P.MAX_CHARS
    full_top: int = P.FULL_TOP
    fields: object = None
    caps: object = None
    tokenizer: str = "heuristic"
    sort: str = "best"
    best: int | None = None
    pinned: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()


def extract(spark: SparkSession, inputs: list[str], recursive: bool = True, any_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cards and failures (path, reason) of PNG files and folders; with any_case *.PNG files too."""
    return S.extract(png.scan(spark, inputs, recursive, any_case))


def _first(df: DataFrame) -> dict:
    return df.first().asDict()


def corpus(scored: DataFrame, tags: bool = True) -> G.Corpus:
    """The aggregates of scored cards; each is one row or a bounded list."""
    found = G.Corpus(_first(A.conv_summary(scored)))
    found.coverage = {r["field"]: r["cards"] for r in A.field_coverage(scored).collect()}
    found.styles = {r["section_style"]: r["cards"] for r in A.section_style_counts(scored).collect()}
    found.sections = [r["name"] for r in A.section_names(scored).orderBy("place").collect()]
    found.stats = _first(A.corpus_stats(scored))
    found.specs = {r["spec_version"]: r["cards"] for r in A.spec_versions(scored).collect()}
    found.tags = [(r["tag"], r["cards"]) for r in A.top_tags(scored).collect()] if tags else []
    found.bloat = [tuple(r) for r in A.top_bloat(scored).collect()]
    found.exemplars = [r["name"] for r in R.exemplars(scored).collect()]
    found.consistency = _first(R.structure_consistency(scored))
    return found


def ordered(cards: DataFrame, o: Options) -> DataFrame:
    """Scored cards with their place in the export (rank) and its length (total): some removed, sorted, cut to the best, pinned first."""
    if o.removed:
        cards = R.without(cards, cards.sparkSession.createDataFrame([(x,) for x in o.removed], "source_file string"))
    scored = cut(R.scored(D.features(cards)))
    if o.best and o.best > 0:
        scored = cut(R.select_best(scored, o.best))
    order = {
        "best": R.best_first(),
        "name": [F.lower(F.coalesce(F.nullif("name", F.lit("")), "nickname")), F.asc("ord")],
        "file": [F.asc("source_file"), F.asc("ord")],
    }[o.sort]
    ranks = R.numbered(scored.select("ord", "name", "nickname", "source_file", "score"), order).select("ord", "source_file", "rank")
    if o.pinned:
        pins = cards.sparkSession.createDataFrame([(x,) for x in o.pinned], "source_file string")
        ranks = R.apply_pins(ranks, pins).select("ord", F.col("place").alias("rank"))
    return cut(scored.join(ranks.select("ord", "rank"), "ord").withColumn("total", F.lit(scored.count())))


def _blocks(placed: DataFrame, o: Options) -> DataFrame:
    cap = None if o.full else o.max_chars
    caps, _ = K.field_caps(o.caps)
    if o.format == "json":
        return K.as_dict(placed, place="rank", cap=cap, full_top=o.full_top, extra=K.extra_fields(o.fields), caps=caps).withColumnRenamed("json", "block")
    return K.blocks(placed, o.format, total=F.col("total"), cap=cap, full_top=o.full_top, extra=K.extra_fields(o.fields), caps=caps)


@dataclass(frozen=True)
class Exported:
    """A finished document with what it was made from."""

    text: str
    tokens: T.TokenCount
    corpus: G.Corpus
    placed: DataFrame


def _frame(known: G.Corpus, o: Options) -> tuple[str, str]:
    """What stands before the cards' blocks and after them; of JSON, the keys before and after `cards`."""
    n = known.summary["total_cards"]
    if o.format == "json":
        head = {
            "note": G.preamble(n), "count": n, "stats": known.stats | {"spec_versions": known.specs, "top_tags": known.tags, "top_bloat_cards": known.bloat}, "field_coverage": known.coverage,
        }
        template = {
            "instruction": G.ANSWER_FORM, "fields": list(G.LABELS), "house_style": G.convention_lines(known), "description_format": G.description_skeleton(known),
            "mes_example_format": G.example_dialogue(known), "not_demonstrated_by_this_corpus": G.coverage_notes(known),
        }
        return json.dumps(head, ensure_ascii=False), json.dumps({"response_template": template}, ensure_ascii=False)
    cap = None if o.full else o.max_chars
    trimmed = 0 if cap is None else max(0, n - max(o.full_top, 0))
    compact = o.format == "compact"
    note = [f"The first {n - trimmed} cards are complete; the other {trimmed} are trimmed to ~{cap:,} characters a field. Statistics cover all {n}."] if trimmed else []
    text = G.template(known, compact)
    stats = G.stats_block(known, compact)
    if compact:
        return "\n".join([G.preamble(n), *note, f"Stats: {stats}", "", *([text, f"({G.REPEAT_NOTE})", ""] if n else [])]), f"\n\n{text}\n"
    filled = ", ".join(f"{f} {known.coverage.get(f, 0)}/{n}" for f in ("description", "personality", "scenario", "first_mes", "mes_example", "tags"))
    lines = [f"# Character Reference Corpus ({n} cards)", "", G.preamble(n), "", *(x for y in note for x in (y, "")), "## Corpus Stats", stats]
    lines += [f"- Field coverage: {filled}"] * bool(n) + [""]
    lines += ["---", "", text, f"*{G.REPEAT_NOTE}*", "", "---", ""] if n else []
    return "\n".join(lines), f"\n\n---\n\n{text}"


def _tokens_line(o: Options, count: T.TokenCount) -> str:
    return ("\n# " if o.format == "compact" else "\n---\n") + f"{count.count:,} tokens ({count.method})"


def exported(cards: DataFrame, o: Options = Options()) -> Exported:
    """The whole document as text. Blocks are made in parallel and read in order."""
    if o.format not in FORMATS:
        raise ValueError(f"unknown format {o.format!r}")
    placed = ordered(cards, o)
    known = corpus(placed, "tags" in K.extra_fields(o.fields))
    blocks = [r["block"] for r in _blocks(placed, o).orderBy("rank").toLocalIterator()]
    head, end = _frame(known, o)
    if o.format == "json":
        payload = json.loads(head) | {"cards": [json.loads(b) for b in blocks]} | json.loads(end)
        count = T.count_tokens(json.dumps(payload, indent=2, ensure_ascii=False), o.tokenizer)
        text = json.dumps(payload | {"tokens": count.count, "token_method": count.method}, indent=2, ensure_ascii=False) + "\n"
        return Exported(text, count, known, placed)
    body = "\n".join([head, *blocks]).rstrip() + "\n"
    count = T.count_tokens(body + end, o.tokenizer)
    text = body + _tokens_line(o, count) + end
    return Exported(text, T.count_tokens(text, o.tokenizer), known, placed)


def export(cards: DataFrame, o: Options = Options()) -> str:
    return exported(cards, o).text


def export_to(cards: DataFrame, folder: str, o: Options = Options()) -> None:
    """The document as part files below `folder`, which may be on any file system Spark writes to: joined in the order of their
    names they are the document. No block comes to the driver. Tokens are the sum over the parts that stand in a row of their own.
    """
    if o.format not in FORMATS:
        raise ValueError(f"unknown format {o.format!r}")
    spark = cards.sparkSession
    placed = ordered(cards, o)
    known = corpus(placed, "tags" in K.extra_fields(o.fields))
    n = known.summary["total_cards"]
    head, end = _frame(known, o)
    blocks = _blocks(placed, o).select("rank", "block")
    total = T.count_tokens(head, o.tokenizer).count + T.count_tokens(end, o.tokenizer).count + (cut(blocks.select(T.tokens_of(F.col("block"), o.tokenizer).alias("tokens"))).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    method = T.count_tokens(head, o.tokenizer).method
    if o.format == "json":
        blocks = blocks.withColumn("block", F.concat("block", F.when(F.col("rank") < n, F.lit(",")).otherwise(F.lit(""))))
        head = head[:-1] + ', "cards": ['
        end = "], " + end[1:-1] + ", " + json.dumps({"tokens": total, "token_method": method})[1:]
    else:
        end = _tokens_line(o, T.TokenCount(total, method, False)).lstrip("\n") + end
    ends = spark.createDataFrame([(0, head), (n + 1, end)], "rank long, block string")
    blocks.unionByName(ends).repartitionByRange("rank").sortWithinPartitions("rank").select("block").write.mode("error").text(folder)


def estimate(cards: DataFrame, o: Options = Options()) -> dict:
    """Tokens of the export and of each card's block, with warnings and how far cards agree. Cards are ranked once."""
    made = exported(cards, o)
    names = made.placed.select("ord", X.title(F.col("name"), F.col("nickname")).alias("name"))
    per_card = _blocks(made.placed, o).select("ord", "rank", T.tokens_of(F.col("block"), o.tokenizer).alias("tokens")).join(names, "ord")
    found = made.corpus.consistency
    return {
        "total_tokens": made.tokens.count,
        "method": made.tokens.method,
        "cards": per_card.orderBy("rank").select(F.col("rank").alias("index"), "name", "tokens"),
        "context_warning": G.context_warning(made.tokens.count, made.corpus.summary["total_cards"], ui=True),
        "consistency": found | {"share": found["structured"] / found["cards"] if found["cards"] else 0.0},
        "consistency_note": G.consistency_note(found),
    }
