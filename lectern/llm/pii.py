"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Candidates are found by one pattern, validated (Luhn sum, octet, calendar and number ranges), and replaced by a keyed
permutation of their own format: an alternating Feistel network over Z_p x Z_q whose round function is SHA-256 of key,
kind, length, round and the other half. As it permutes the format's whole domain, equal values get equal pseudonyms in
every document, different values get different ones, and whoever has the key can undo it (of the kinds in this table).

| kind | valid if | domain that is permuted |
|-|-|-|
| card | 13 to 19 digits with a right Luhn sum | digits between the first and the check digit, which is made anew |
| phone | 3 + 3 + 4 digits, country code allowed, or + and 8 to 15 digits | the last ten digits, of fewer all but the first |
| iban | a right remainder by 97 | the account part's digits; check digits are made anew |
| ssn | number ranges as issued | area, group and serial in those ranges |
| ip | four octets | all of them |
| date | a day from 1000 to 2099, Y-M-D or D-M-Y (else M-D-Y) | the days of its century |

E-mail names and secrets of 32 to 64 hex digits have no number to permute; they get a keyed digest in their own format, with
an e-mail's domain kept. Digests cannot be undone, and those of two e-mail names (48 bits) may by chance be equal. Invalid candidates stay as they are.

Cases: a null text stays null with counts of 0, an empty one empty; the same value written with other separators gets the
same digits; repeated doc_ids are separate rows; an empty table gives an empty result; other columns are kept by
`pseudonymise`, but for those that its counts replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import column, table

KINDS = ("email", "ip", "date", "ssn", "phone", "card", "iban", "secret")
#: A key for tests and the registered queries; a caller with private data passes its own.
EXAMPLE_KEY = "lectern-example-key"
ROUNDS = 10

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR = "(?:1[0-9]|20)[0-9]{2}"
_PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,8}",
    "ip": f"(?<![0-9])(?<![0-9][.])(?:{_OCTET}[.]){{3}}{_OCTET}(?![0-9])(?![.][0-9])",
    "date": f"(?<![0-9])(?:{_YEAR}([-/.])[0-9]{{2}}\\1[0-9]{{2}}|[0-9]{{2}}([-/.])[0-9]{{2}}\\2{_YEAR})(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?<![0-9A-Za-z])(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)][ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])[+][0-9]{8,15}(?![0-9])",
    "card": "(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\3[0-9]{4}\\3[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "secret": "(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
PATTERN = "|".join(f"(?:{x})" for x in _PATTERNS.values())


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(key: str, kind: str, tweak: str, a: str, b: str, p: str, q: str) -> str:
    """SQL for struct(a, b) of a keyed permutation of Z_p x Z_q; a, b, p, q, tweak: SQL."""
    f = f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, '{kind}', {tweak}, i, %s), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0, "
        f"named_struct('a', (s.a + {f % 's.b'}) % cast({p} as bigint), 'b', s.b), named_struct('a', s.a, 'b', (s.b + {f % 's.a'}) % cast({q} as bigint))))"
    )


def _with(name: str, value: str, then: str) -> str:
    """SQL `then`, in which `name` stands for `value`, computed once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _number(kind: str, key: str) -> str:
    """SQL for the new digits of the match m (its digits: d), null if it isn't valid."""
    ten = lambda n: f"rpad('1', {n} + 1, '0')"
    if kind == "card":
        # s: the Luhn sum of the digits x, with the one at place length(x) + 1 as check digit.
        luhn = lambda x: f"aggregate(sequence(1, length({x})), 0, (t, i) -> t + if((length({x}) - i) % 2 = 0, int(substr('0246813579', int(substr({x}, i, 1)) + 1, 1)), int(substr({x}, i, 1))))"
        body = "substr(d, 1, length(d) - 1)"
        u, v = "((length(d) - 1) div 2)", "((length(d) - 2) div 2)"
        new = _with("f", _feistel(key, kind, "length(d)", f"substr(d, 2, {u})", f"substr(d, 2 + {u}, {v})", ten(u), ten(v)), f"concat(substr(d, 1, 1), lpad(f.a, {u}, '0'), lpad(f.b, {v}, '0'))")
        return f"if(({luhn(body)} + int(right(d, 1))) % 10 = 0, {_with('n', new, f'concat(n, (10 - {luhn("n")} % 10) % 10)')}, null)"
    if kind == "phone":
        k = "if(length(d) >= 10, 10, length(d) - 1)"
        u, v = f"(({k} + 1) div 2)", f"({k} div 2)"
        return _with("f", _feistel(key, kind, k, f"substr(right(d, {k}), 1, {u})", f"right(d, {v})", ten(u), ten(v)), f"concat(substr(d, 1, length(d) - {k}), lpad(f.a, {u}, '0'), lpad(f.b, {v}, '0'))")
    if kind == "ssn":
        area, group, serial = "int(substr(d, 1, 3))", "int(substr(d, 4, 2))", "int(substr(d, 6, 4))"
        rank = f"(({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1)"  # areas 1 to 899 but 666
        back = "(f.a div 99 + 1 + if(f.a div 99 + 1 >= 666, 1, 0))"
        new = _with("f", _feistel(key, kind, "9", rank, f"{serial} - 1", "898 * 99", "9999"), f"concat(lpad({back}, 3, '0'), lpad(f.a % 99 + 1, 2, '0'), lpad(f.b + 1, 4, '0'))")
        return f"if({area} between 1 and 899 and {area} != 666 and {group} > 0 and {serial} > 0, {new}, null)"
    raise ValueError(kind)


def _replacement(kind: str, key: str) -> str:
    """SQL for what stands for the match m, null if it isn't valid."""
    if kind == "email":
        tag = f"conv(substr(sha2(concat_ws('|', {_text(key)}, 'email', lower(m)), 256), 1, 12), 16, 10)"
        return f"concat('user', lpad({tag}, 15, '0'), substr(m, instr(m, '@')))"
    if kind == "secret":
        tag = f"substr(sha2(concat_ws('|', {_text(key)}, 'secret', lower(m)), 256), 1, length(m))"
        return f"if(m rlike '[0-9]', if(m = upper(m), upper({tag}), {tag}), null)"
    if kind == "ip":
        o = lambda i: f"int(split(m, '[.]')[{i}])"
        return _with("f", _feistel(key, kind, "4", f"{o(0)} * 256 + {o(1)}", f"{o(2)} * 256 + {o(3)}", "65536", "65536"), "concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)")
    if kind == "iban":
        # The remainder of the letters (A is 10) and digits from the fifth on, then of the first four.
        turned = lambda x: f"concat(substr(replace({x}, ' ', ''), 5), substr(replace({x}, ' ', ''), 1, 4))"
        rest = lambda x: _with("w", turned(x), "aggregate(sequence(1, length(w)), 0, (r, i) -> if(substr(w, i, 1) < 'A', r * 10 + int(substr(w, i, 1)), r * 100 + ascii(substr(w, i, 1)) - 55) % 97)")
        n = "(length(d) - 2)"
        u, v = f"(({n} + 1) div 2)", f"({n} div 2)"
        digits = _with("f", _feistel(key, kind, n, f"substr(d, 3, {u})", f"right(d, {v})", f"rpad('1', {u} + 1, '0')", f"rpad('1', {v} + 1, '0')"), f"concat('00', lpad(f.a, {u}, '0'), lpad(f.b, {v}, '0'))")
        made = _with("n", digits, _with("z", _in_place("n"), f"concat(substr(z, 1, 2), lpad(98 - {rest('z')}, 2, '0'), substr(z, 5))"))
        return f"if(length(d) >= 4 and {rest('m')} = 1, {made}, null)"
    if kind == "date":
        # A century has 36524 = 92 * 397 days, or 36525 = 75 * 487 if divisible by 400.
        q = "if((year(t) div 100) % 4 = 0, 487, 397)"
        p = "if((year(t) div 100) % 4 = 0, 75, 92)"
        first = "make_date((year(t) div 100) * 100, 1, 1)"
        day = f"datediff(t, {first})"
        new = lambda form: _with("f", _feistel(key, kind, "year(t) div 100", f"{day} div {q}", f"{day} % {q}", p, q), f"date_format(date_add({first}, int(f.a * {q} + f.b)), '{form}')")
        got = []
        for test, form in (("^[0-9]{4}", "yyyyMMdd"), ("^[0-9]{2}[^0-9]", "ddMMyyyy"), ("^[0-9]{2}[^0-9]", "MMddyyyy")):
            got.append(f"if(m rlike '{test}', {_with('t', f'cast(try_to_timestamp(d, {_text(form)}) as date)', f'if(t is null, null, {new(form)})')}, null)")
        return _with("n", f"coalesce({', '.join(got)})", _in_place("n"))
    return _with("n", _number(kind, key), _in_place("n"))


def _in_place(new: str) -> str:
    """SQL for m with its digits replaced by those of `new`, null if that is."""
    place = "length(regexp_replace(substr(m, 1, i), '[^0-9]', ''))"
    return f"if({new} is null, null, array_join(transform(sequence(1, length(m)), i -> if(substr(m, i, 1) between '0' and '9', substr({new}, {place}, 1), substr(m, i, 1))), ''))"


def _kind() -> str:
    """SQL for the kind of the match m; each is one of PATTERN's branches, told apart by form."""
    return (
        "case when m like '%@%' then 'email' when m rlike '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$' then 'ip' "
        "when m rlike '^[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}$' or m rlike '^[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}$' then 'date' "
        "when m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' then 'ssn' when m rlike '^[0-9a-fA-F]{32,64}$' then 'secret' when m rlike '^[A-Z]' then 'iban' "
        "when m rlike '^[0-9]{13,19}$' or m rlike '^[0-9]{4}[ -]' then 'card' else 'phone' end"
    )


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """`docs` with its text pseudonymised and, if `counts`, n_<kind> for each of KINDS (long). Whoever has the key can undo it."""
    if not key:
        raise ValueError("a key is needed")
    text = column(docs, text_col)
    found = "case k " + " ".join(f"when '{x}' then {_replacement(x, key)}" for x in KINDS) + " end"
    match = _with("k", _kind(), _with("d", "regexp_replace(m, '[^0-9]', '')", f"named_struct('m', m, 'k', k, 'r', {found})"))
    names = docs.columns
    added = [f"n_{x}" for x in KINDS] if counts else []
    work, items = (f"{x}_{max(map(len, names), default=0)}" + "_" * max(map(len, names), default=0) for x in ("matches", "items"))  # longer than any name there
    has = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    out = docs.withColumn(work, F.when(has, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    out = out.withColumn(items, F.expr(f"transform({work}, m -> {match})"))
    new = F.when(F.size(items) > 0, F.array_join(F.zip_with(F.split(column(out, text_col), PATTERN, -1), items, lambda p, x: F.concat(p, F.coalesce(x["r"], x["m"], F.lit("")))), "")).otherwise(column(out, text_col))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(items, lambda x: (x["k"] == kind) & x["r"].isNotNull())), F.lit(0)).cast("long").alias(f"n_{kind}")

    kept = [new.alias(text_col) if x == text_col else column(out, x) for x in names if x not in added]
    return out.select(*kept, *(F.greatest(count(x), F.lit(0)).cast("long").alias(f"n_{x}") for x in KINDS if counts))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=EXAMPLE_KEY)
