"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

`statistics` counts words, repeated windows, repeated lines and symbols of whole texts. `judge` fits, for each language
and source, the location and scatter of the transformed statistic vectors by the minimum (regularised) covariance
determinant, and rejects vectors whose Mahalanobis distance exceeds a chi-squared cutoff.

The fit covers all rows that pass the base rules. Vectors are fixed-point, so all sums are exact and order does not
matter. A concentration step is one grouped sum over (group, start, distance class): the classes of smallest distance
that together hold the share `SUBSET` of the group give the next location and scatter. No group is ever gathered: a task
sees at most the classes' sums. Steps start from medians with MAD and from the plain mean and covariance. A fit goes on while its determinant falls by `SETTLED` at
least in its logarithm, which floors bound below, so every fit settles; it keeps its least. Of the starts the smallest determinant wins. `FLOORS` is added to every scatter's diagonal, as many statistics are 0
in most texts: differences below a floor are no evidence by themselves. Where nobody repeats, more than 36 % of repeated lines,
or of words in repeated windows, are beyond the cutoff alone.

A group with fewer than `MIN_GROUP` rows takes its language's fit over all sources, and a language with fewer takes the fit of
all rows.

Cases: a null or blank text has no words and fails the base rules; a null language or source is a value like any other;
repeated doc_ids are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import column, cut, few, released, table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Names and scatter floors of the vector: log of the mean word length; arcsine roots of symbols by characters, of repeated
#: lines by lines and of words in repeated windows by words.
NAMES = ("x_length", "x_symbols", "x_lines", "x_windows")
FLOORS = (0.08, 0.03, 0.12, 0.12)
P = len(NAMES)
#: Fixed point of the vectors; share of a group that a fit rests on; chance that a clean vector exceeds the cutoff.
SCALE, SUBSET, REJECT = 1000, 0.6, 1e-5
MIN_GROUP = 50
#: Fall of the log determinant below which a fit has settled.
SETTLED = 1e-4
#: Groups times starts up to which their parameters are broadcast (some 400 bytes each); beyond, they are joined.
BROADCAST_ROWS = 20_000
#: Parts that a group's rows are dealt to where parameters are joined.
SALTS = 32


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    if n > 50_000:  # numbers in place of tuples, to bound memory
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, where, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[where] > 1
    else:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        count = Counter(windows)
        twice = np.fromiter((count[x] > 1 for x in windows), np.bool_, n - 2)
    inside = np.zeros(n, np.bool_)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    chars = len(text) - (len(data) - sum(map(len, words)))
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed, and the vector (null where base_failed)."""
    types = [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_())] + [(c, pa.int32()) for c in NAMES]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = lambda part, whole: round(SCALE * math.asin(math.sqrt(min(1.0, part / max(whole, 1)))))
        for b in batches:
            rows = []
            for x in b.column(3):
                n, chars, symbols, dup, rep, lines = text_statistics(x.as_py())
                failed = n < MIN_WORDS or 100 * rep > 50 * n
                vector = (None,) * P if failed else (round(SCALE * math.log(chars / n)), root(symbols, chars), root(dup, lines), root(rep, n))
                rows.append((n, chars, symbols, dup, rep, failed, *vector))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types))], names=["doc_id", "lang", "source", *(c for c, _ in types)])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, lang_col).cast("string").alias("lang"), column(docs, source_col).cast("string").alias("source"), column(docs, text_col).alias("text"))
    longs = ", ".join(f"{c} long" for c, t in types if t == pa.int64())
    return rows.mapInArrow(released(run), f"doc_id {kind}, lang string, source string, {longs}, base_failed boolean, " + ", ".join(f"{c} int" for c in NAMES))


def chi2_cdf(x: float, k: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def chi2_quantile(q: float, k: int) -> float:
    z = NormalDist().inv_cdf(q)
    low, high = 0.0, 4 * k * max(1.0, 1 - 2 / (9 * k) + abs(z) * math.sqrt(2 / (9 * k))) ** 3 + 50
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


#: Makes the scatter of the closest SUBSET of normal vectors that of all of them.
CONSISTENCY = SUBSET / chi2_cdf(chi2_quantile(SUBSET, P), P + 2)
CUTOFF = chi2_quantile(1 - REJECT, P)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"c{i}{j}" for i, j in _PAIRS)]
_PARAMS = [*(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in _PAIRS), "det"]
_PARAM_TYPES = ", ".join(f"{c} double" for c in _PARAMS)


def _parameters(location: np.ndarray, scatter: np.ndarray) -> list[float]:
    """What the distance needs: location, weights of products (inverse scatter), and the log determinant."""
    scatter = scatter + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(scatter)
    return [*location.tolist(), *(float(inverse[i, j]) * (1 if i == j else 2) for i, j in _PAIRS), float(np.linalg.slogdet(scatter)[1])]


def _moments(sums: dict, factor: float) -> list[float]:
    n = float(sums["n"])
    mean = np.array([sums[f"s{i}"] / n for i in range(P)]) / SCALE
    scatter = np.zeros((P, P))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = sums[f"c{i}{j}"] / n / SCALE**2 - mean[i] * mean[j]
    return _parameters(mean, factor * scatter)


def _one(key: str, start: int, params: list[float]) -> pa.Table:
    return pa.table({"fit": pa.array([key]), "start": pa.array([start], pa.int32()), **{c: pa.array([x], pa.float64()) for c, x in zip(_PARAMS, params, strict=True)}})


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector for the parameters beside it."""
    d = [F.col(NAMES[i]) / F.lit(float(SCALE)) - F.col(f"m{i}") for i in range(P)]
    return F.greatest(F.lit(0.0), sum((F.col(f"w{i}{j}") * d[i] * d[j] for i, j in _PAIRS), F.lit(0.0)))


def _sums() -> list[Column]:
    x = [F.col(c).cast("long") for c in NAMES]
    return [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"c{i}{j}") for i, j in _PAIRS)]


def _join(rows: DataFrame, small: DataFrame, n_small: int, keys: list[str]) -> DataFrame:
    """`rows` with what `small` has for their keys: by broadcast up to a checked size, else dealt by key and salt, so that
    a hot key's rows meet its parameters in many tasks."""
    if n_small <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", *NAMES), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def _medians(t: pa.Table) -> pa.Table:
    """First parameters from counts of values by coordinate: medians and scaled median absolute deviations."""

    def middle(value: np.ndarray, count: np.ndarray) -> float:
        order = np.argsort(value, kind="stable")
        total = np.cumsum(count[order])
        return float(value[order][np.searchsorted(total, (total[-1] + 1) // 2)])

    axis, values, counts = (t[c].to_numpy() for c in ("axis", "value", "n"))
    location, spread = np.zeros(P), np.zeros(P)
    for i in range(P):
        value, count = values[axis == i].astype(np.float64), counts[axis == i]
        location[i] = middle(value, count)
        spread[i] = 1.4826 * middle(np.abs(value - location[i]), count)
    return _one(t["fit"][0].as_py(), 0, _parameters(location / SCALE, np.diag((spread / SCALE) ** 2)))


def _concentrate(t: pa.Table) -> pa.Table:
    """Next parameters from the sums of distance classes: the nearest that hold SUBSET of the rows."""
    t = t.sort_by("near")
    total = np.cumsum(t["n"].to_numpy())
    last = int(np.searchsorted(total, math.ceil(SUBSET * total[-1])))
    return _one(t["fit"][0].as_py(), t["start"][0].as_py(), _moments({c: int(t[c].to_numpy()[: last + 1].sum()) for c in _SUMS}, CONSISTENCY))


def _plain(t: pa.Table) -> pa.Table:
    return _one(t["fit"][0].as_py(), 1, _moments({c: t[c][0].as_py() for c in _SUMS}, 1.0))


def fit(rows: DataFrame) -> DataFrame:
    """Parameters of each `fit` of rows (columns fit, doc_id and the vector): fit, m*, w*, det."""
    schema = f"fit string, start int, {_PARAM_TYPES}"
    axes = F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(c).alias("value")) for i, c in enumerate(NAMES)))).alias("a")
    values = rows.select("fit", axes).groupBy("fit", F.col("a.axis").alias("axis"), F.col("a.value").alias("value")).agg(F.count("*").alias("n"))
    first = values.groupBy("fit").applyInArrow(_medians, schema)
    plain = rows.groupBy("fit").agg(*_sums()).groupBy("fit").applyInArrow(_plain, schema)
    starts = cut(first.unionByName(plain))
    near = F.floor(16 * F.log(_distance() + F.lit(1e-9))).cast("int")
    names = ["fit", "start", *_PARAMS]

    def step(params: DataFrame, n: int) -> DataFrame:
        sums = _join(rows, params, n, ["fit"]).select("fit", "start", near.alias("near"), *NAMES).groupBy("fit", "start", "near").agg(*_sums())
        return sums.groupBy("fit", "start").applyInArrow(_concentrate, schema)

    # The starts' own determinants are no subset's, so the first step counts whatever it gives.
    best = active = cut(few(step(starts, n := starts.count()), 100 * n))  # a fit's sums are some hundred rows
    while n:
        after = step(active, n).select("fit", "start", F.struct(*_PARAMS).alias("new"))
        stepped = cut(few(best.select("fit", "start", F.struct(*_PARAMS).alias("best")).join(after, ["fit", "start"], "left"), 100 * n))
        fell = lambda by: F.coalesce(F.col("new.det") < F.col("best.det") - by, F.lit(False))
        best = stepped.select("fit", "start", F.when(fell(0), F.col("new")).otherwise(F.col("best")).alias("p")).select("fit", "start", "p.*").select(names)
        active = stepped.where(fell(SETTLED)).select("fit", "start", "new.*").select(names)
        n = active.count()
    nth = F.row_number().over(Window.partitionBy("fit").orderBy("det", "start"))
    return best.withColumn("nth", nth).where("nth = 1").drop("nth", "start")


def judge(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared, null if
    base_failed), fitted_on (source, language or all: the rows whose fit judged the document; null if base_failed)."""
    stats = cut(statistics(docs, **names))
    good = stats.where("not base_failed")
    groups = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("lang_n", F.sum("n").over(by_lang)).withColumn("level", F.when(F.col("n") >= MIN_GROUP, 2).when(F.col("lang_n") >= MIN_GROUP, 1).otherwise(0)).withColumn("need1", F.max(F.col("level") == 1).over(by_lang))
    groups = cut(groups)
    n_groups = groups.count()
    need0 = not groups.where("level = 0").isEmpty()
    own = F.to_json(F.array(F.lit("2"), "lang", "source"))
    lang, everything = F.to_json(F.array(F.lit("1"), "lang")), F.lit("all")
    level = F.col("level")
    fits = F.filter(F.array(F.when(level == 2, own), F.when(F.col("need1"), lang), F.when(F.lit(need0), everything)), lambda x: x.isNotNull())
    # Null-safe keys by JSON, so that null languages and sources join as values.
    pair = F.to_json(F.array("lang", "source"))
    where = groups.select(pair.alias("pair"), F.when(level == 2, "source").when(level == 1, "language").otherwise("all").alias("fitted_on"), F.when(level == 2, own).when(level == 1, lang).otherwise(everything).alias("own"), fits.alias("fits"))
    rows = cut(_join(good.withColumn("pair", pair), where.drop("fitted_on"), n_groups, ["pair"]).select("doc_id", "own", "fits", *NAMES))
    params = cut(fit(rows.select(F.explode("fits").alias("fit"), "doc_id", *NAMES)))
    dealt = _join(stats.where("not base_failed").withColumn("pair", pair), where.select("pair", "fitted_on", F.col("own").alias("fit")), n_groups, ["pair"])
    judged = _join(dealt, params, n_groups, ["fit"]).withColumn("distance", _distance())
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    bad = stats.where("base_failed").select(*base, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("fitted_on"))
    return judged.select(*base, (F.col("distance") <= F.lit(CUTOFF)).alias("kept"), "distance", "fitted_on").unionByName(bad)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
