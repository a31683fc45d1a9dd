"""Cards from payloads: decoding, versions, aliases, coercion and cleaning. Catalyst expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.schema import ALIASES, CARD, CLEANED, KEYWORDS, LISTS
from . import png

#: Fixed value: the reason given for a file without a card.
NO_CARD = f"no usable character card data found (looked for keywords: {', '.join(KEYWORDS)})"


def let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def decoded(text: Column) -> Column:
    """A payload as VARIANT: base64 of UTF-8 JSON, else JSON itself, else null. Signs outside the base64 alphabet are
    dropped and padding must be whole, as lenient decoders have it; keys that come twice keep their last value only where
    spark.sql.variant.allowDuplicateKeys is set."""

    def parsed(bare: Column) -> Column:
        quads = F.regexp_extract(F.regexp_replace(bare, "[^A-Za-z0-9+/=]", ""), "^([A-Za-z0-9+/]*={0,2})", 1)
        raw = let(quads, lambda q: F.when(F.length(q) % 4 == 0, F.try_to_binary(q, F.lit("base64"))).cast("string"))
        return F.coalesce(let(raw, lambda r: F.try_parse_json(F.when(F.is_valid_utf8(r), r))), F.try_parse_json(bare))

    return let(X.strip(text), parsed)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _word(v: Column) -> Column:
    """A scalar as text; truth values with a capital, nested values as JSON."""

    def text(kind: Column, v: Column) -> Column:
        return F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))

    return let(v, lambda v: let(_kind(v), lambda k: text(k, v)))


def _given(v: Column) -> Column:
    """The value, or null where it is absent, null or empty text."""
    return let(v, lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v) & (F.to_json(v) != '""'), v))


def first_present(data: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(_given(_get(data, f"$.{n}")) for n in names))


def _truthy(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v) & ~F.to_json(v).isin('""', "0", "0.0", "false", "[]", "{}")


def text_list(v: Column) -> Column:
    """A list of texts from a list or one text; anything else gives none."""
    none = F.array().cast("array<string>")

    def items(v: Column) -> Column:
        kind = _kind(v)
        many = F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), _truthy), _word)
        return F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), many)

    return F.coalesce(let(v, items), none)


def lorebook(data: Column) -> Column:
    """Entries of a card's book: objects only; keys, or key, or none; a single key text is a list of one."""
    entries = F.coalesce(F.try_variant_get(data, "$.character_book.entries", "array<variant>"), F.array().cast("array<variant>"))

    def entry(e: Column) -> Column:
        keys = F.coalesce(*(let(_get(e, f"$.{n}"), lambda v: F.when(_truthy(v), v)) for n in ("keys", "key")))
        return F.struct(text_list(keys).alias("keys"), *(F.coalesce(_word(_get(e, f"$.{n}")), F.lit("")).alias(n) for n in ("content", "comment")))

    return F.transform(F.filter(entries, lambda e: _kind(e).startswith("OBJECT")), entry)


def unwrapped(payload: Column, keyword: str) -> Column:
    """Struct of the card's object, its version and keyword: wrapped cards name their version, bare ones are 1.0; data is null for no object."""

    def parts(p: Column) -> Column:
        spec = F.try_variant_get(p, "$.spec", "string")
        is_object = _kind(p).startswith("OBJECT")
        wrapped = F.coalesce(is_object & (_kind(_get(p, "$.spec")) == "STRING") & spec.startswith("chara_card"), F.lit(False))
        named = let(_get(p, "$.spec_version"), lambda v: F.when(_truthy(v), _word(v)))
        version = F.when(wrapped, F.coalesce(named, F.when(spec.contains("v3"), "3.0").otherwise("2.0"))).otherwise(F.lit("1.0"))
        data = let(F.when(wrapped, _get(p, "$.data")).when(is_object, p), lambda d: F.when(_kind(d).startswith("OBJECT"), d))
        return F.struct(data.alias("data"), version.alias("version"), F.lit(keyword).alias("keyword"))

    return let(payload, parts)


def _text(data: Column, name: str) -> Column:
    return F.coalesce(_word(first_present(data, ALIASES[name])), F.lit(""))


def is_card(data: Column) -> Column:
    """Whether an object has a name, or a description, personality or first message that cleaning leaves something of."""
    return data.isNotNull() & ((_text(data, "name") != "") | (F.concat(*(X.cleaned(_text(data, n)) for n in ("description", "personality", "first_mes"))) != ""))


def _clean_pair(value: Column) -> Column:
    return let(value, lambda t: let(X.cleaned(t), lambda x: F.struct(x.alias("text"), X.removed(t, x).alias("removed"))))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def parse(chunked: DataFrame) -> DataFrame:
    """path, card (null for a failure), error, of rows with path, chunks and error."""
    kept = [c for c in chunked.columns if c not in ("chunks", "error")]
    col = F.col

    def last(keyword: str) -> Column:
        return F.nullif(F.try_element_at(F.filter("chunks", lambda x: x["keyword"] == keyword), F.lit(-1))["text"], F.lit(""))

    found = chunked.withColumn("found__", F.array(*(unwrapped(decoded(last(k)), k) for k in KEYWORDS)))
    chosen = found.withColumn("from__", F.get(F.filter("found__", lambda f: F.coalesce(is_card(f["data"]), F.lit(False))), F.lit(0)))
    chosen = chosen.withColumn("data__", col("from__.data"))
    raw = chosen.withColumns({f"f__{n}": text_list(first_present(col("data__"), ALIASES[n])) if n in LISTS else _text(col("data__"), n) for n in ALIASES} | {"f__book": lorebook(col("data__"))})
    pairs = {f"p__{n}": _clean_pair(col(f"f__{n}")) for n in CLEANED} | {
        "p__greetings": F.transform("f__alternate_greetings", _clean_pair),
        "p__book": F.transform("f__book", lambda e: F.struct(e["keys"].alias("keys"), _clean_pair(e["content"]).alias("c"), e["comment"].alias("comment"))),
    }
    done = raw.withColumns(pairs)
    fields = []
    for n in ALIASES:
        if n in CLEANED:
            fields.append(col(f"p__{n}.text").alias(n))
        elif n == "alternate_greetings":
            fields.append(F.transform("p__greetings", lambda g: g["text"]).alias(n))
        else:
            fields.append(col(f"f__{n}").alias(n))
    fields.append(F.transform("p__book", lambda e: F.struct(e["keys"].alias("keys"), e["c"]["text"].alias("content"), e["comment"].alias("comment"))).alias("lorebook_entries"))
    lost = F.array(*(col(f"p__{n}.removed") for n in CLEANED))
    total = _sum(F.concat(lost, F.transform("p__greetings", lambda g: g["removed"]), F.transform("p__book", lambda e: e["c"]["removed"])))
    body = F.struct(*fields, col("from__.version").alias("spec_version"), col("from__.keyword").alias("source_keyword"), total.alias("bloat_chars_removed"))
    is_found = col("data__").isNotNull()
    return done.select(*kept, F.when(is_found, body).alias("card"), F.coalesce("error", F.when(~is_found, F.lit(NO_CARD))).alias("error"))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards, and failures (path, reason), of rows with ord, path and content, or with chunks and error in place of content."""
    parsed = parse(png.with_chunks(files) if "content" in files.columns else files)
    cards = parsed.where("card is not null").select("ord", "card.*", F.col("path").alias("source_file"))
    cards = cards.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CARD.fields))
    return cards, parsed.where("card is null").select("path", F.col("error").alias("reason"))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Cards of JSON texts in the engine's own form; unknown keys are dropped, absent fields are empty."""
    card = F.from_json(F.col(column), CARD)
    full = rows.select(card.alias("card")).select("card.*")
    fill = [F.coalesce(F.col(f.name), _empty(f)).alias(f.name) for f in CARD.fields]
    return full.select(*fill)


def _empty(field) -> Column:
    kind = field.dataType.simpleString()
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit({"string": "unknown" if field.name == "spec_version" else "", "bigint": 0}[kind])


def extract_bytes(spark: SparkSession, uploads: list[tuple[str, bytes]]) -> tuple[DataFrame, DataFrame]:
    """Cards and failures of named byte strings."""
    rows = [(i, name, bytearray(data)) for i, (name, data) in enumerate(uploads)]
    return extract(spark.createDataFrame(rows, "ord long, path string, content binary"))
