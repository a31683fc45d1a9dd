"""The ten operators on small hand-made tables: against brute force, and in the awkward cases each docstring names."""

import datetime
import gzip
import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from lectern.llm import components, language, packing, pii, quality, sentence_pieces, sharding, similar, simhash, suffixes, vectors, warc, word_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, odd characters, very long texts.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "word", None, "a", 4), (5, "two words", "en", "a", 9), (5, "two words", "en", "a", 9),
    (6, "é漢字🎉 \x0b x\x1cy z 'tis don't <|endoftext|>", "fr", "b", 9), (7, "long " * 60_000, "en", "a", 300_000), (8, "long " * 60_000, "en", "a", 300_000), (None, "no id at all", "en", "a", 12),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"bucket": F.lit(1), "part": F.lit("p"), "size": F.lit(2), "kept": F.lit(None).cast("boolean"), "a.b": F.lit(3), "n_email": F.lit(9), "rank": F.lit(0)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


def words(seed, n, size=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(size)]
    return " ".join(rng.choices(vocabulary, k=n))


# --- 1: quality rules ---------------------------------------------------------------------------------------------
def brute_statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = list(zip(w, w[1:], w[2:], strict=False))
    count, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_statistics():
    rng = random.Random(1)
    texts = [t for _, t, *_ in ODD] + ["".join(rng.choices(["a ", "b ", "c\n", "#x ", " ", "\n"], k=rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert quality.text_statistics(t)[:5] == brute_statistics(t)
    big = words(2, 60_000, 30).encode().split()
    assert quality.repeated_words(big) == brute_statistics(b" ".join(big).decode())[4]


def junk(i):
    return " ".join(f"{w}###" for w in words(i, 80).split())


def test_quality_rejects_outliers_only(spark):
    clean = [(i, words(i, 60 + i % 200), ("en", "de")[i % 2], f"s{i % 3}", 0) for i in range(600)]
    bad = [(1000 + i, junk(i), "en", f"s{i % 3}", 0) for i in range(30)] + [(2000, "a b c " * 40, "en", "s0", 0), (2001, "few words", "en", "s0", 0)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(clean + bad, SCHEMA)).collect()}
    assert len(got) == 632 and all(got[i]["kept"] for i in range(600))
    assert not any(got[1000 + i]["kept"] or got[1000 + i]["base_failed"] for i in range(30))
    assert got[2000]["base_failed"] and got[2001]["base_failed"] and got[2000]["distance"] is None


@pytest.mark.parametrize("kind", ["lines", "windows"])
def test_quality_rejects_repetition_alone(spark, kind):
    """Texts with usual words and no symbols, whose lines or three-word windows alone repeat, where nobody else's do."""
    rng, vocabulary = random.Random(5), words(0, 4000, 4000).split()
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    lines = lambda: [some(3) for _ in range(40)]
    clean = [(i, "\n".join(lines()), "en", "s", 0) for i in range(300)]
    if kind == "lines":  # one-word lines between others, so that few windows repeat
        odd = [(1000 + i, "\n".join(x for k, line in enumerate(lines()) for x in (line, *["again"] * (k % 4))), "en", "s", 0) for i in range(5)]
    else:
        odd = [(1000 + i, "\n".join(lines()[:30]) + f" {some(36)}" * 2, "en", "s", 0) for i in range(5)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(clean + odd, SCHEMA)).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert not any(got[1000 + i]["kept"] or got[1000 + i]["base_failed"] for i in range(5))


def brute_mcd(x, rounds=300):
    """Location and scatter of the subset of least determinant that many random starts' concentration steps come to."""
    rng, n = np.random.default_rng(1), len(x)
    h = math.ceil(quality.SUBSET * n)
    best = None

    def estimate(some):
        return some.mean(0), quality.CONSISTENCY * np.cov(some.T, bias=True) + np.diag(np.square(quality.FLOORS))

    for _ in range(rounds):
        mean, scatter = estimate(x[rng.choice(n, quality.P + 2, replace=False)])
        det = math.inf
        while True:
            d = ((x - mean) @ np.linalg.inv(scatter) * (x - mean)).sum(1)
            mean, scatter = estimate(x[np.argsort(d, kind="stable")[:h]])
            now = np.linalg.slogdet(scatter)[1]
            if now >= det - 1e-12:
                break
            det = now
        if best is None or det < best[0]:
            best = det, mean, scatter
    return best


def test_quality_keeps_what_a_searched_mcd_keeps(spark):
    """Three groups with outliers on each axis: determinants near those of 300 random starts, and the same verdicts."""
    rng, vocabulary = random.Random(8), words(0, 4000, 4000).split()
    wide = [x + "qrstuvwxyzq" for x in vocabulary]
    rows = []
    for g, size in (("a", 60), ("b", 90), ("c", 150)):
        for i in range(size):
            text = "\n".join(" ".join(rng.choices(vocabulary, k=rng.randrange(4, 9))) + rng.choice(["", "", " #", " & |"]) for _ in range(rng.randrange(12, 30)))
            if i % 25 == 1:
                text += " #$%&" * 60
            if i % 25 == 2:
                text = " ".join(rng.choices(wide, k=90))
            if i % 25 == 3:
                text += "\n" + "\n".join(["over again"] * 60 if i % 2 else [" ".join(rng.choices(vocabulary, k=40))] * 3)
            rows.append((len(rows), text, "en", g, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    stats = quality.statistics(docs).where("not base_failed").toPandas()
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    rejected = 0
    for _, part in stats.groupby("source"):
        x = part[list(quality.NAMES)].to_numpy() / quality.SCALE
        _, mean, scatter = brute_mcd(x)
        d = ((x - mean) @ np.linalg.inv(scatter) * (x - mean)).sum(1)
        kept = dict(zip(part["doc_id"].tolist(), (d <= quality.CUTOFF).tolist(), strict=True))
        assert {i: got[i]["kept"] for i in kept} == kept and got[min(kept)]["fitted_on"] == "source"
        rejected += sum(not v for v in kept.values())
    assert rejected >= 24


def test_quality_is_one_whatever_the_partitions_and_join(spark, monkeypatch):
    rows = [(i, words(i, 60 + i % 90) + (" ## |" * (i % 7)), ("en", None)[i % 11 == 0], f"s{i % 3}", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(quality.judge(df.repartition(1)).collect(), key=repr)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(quality.judge(df.repartition(7)).collect(), key=repr) == one


def test_chi2():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.95, 4), 4) - 0.95) < 1e-9 and abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3


def test_concentration_step_matches_numpy():
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal(0, 0.5, (500, quality.P)) * quality.SCALE).astype(int)
    sums = {"n": len(x)} | {f"s{i}": int(x[:, i].sum()) for i in range(quality.P)} | {f"c{i}{j}": int((x[:, i] * x[:, j]).sum()) for i, j in quality._PAIRS}
    got = quality._moments(sums, 1.0)
    v = x / quality.SCALE
    scatter = np.cov(v.T, bias=True) + np.diag(np.square(quality.FLOORS))
    assert np.allclose(got[: quality.P], v.mean(0)) and np.isclose(got[-1], np.linalg.slogdet(scatter)[1])


# --- 2: language ----------------------------------------------------------------------------------------------------
def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_does_not_learn_from_held_out_rows(spark):
    rows = [(i, f"marker{i} " + words(i, 50), "en", "s", 0) for i in range(60)]
    found = language.learn(spark.createDataFrame(rows, SCHEMA))["en"].decode()
    for i in range(60):
        assert (f"marker{i} " in found) == (zlib.crc32(str(i).encode()) % 3 != 1)


def test_language_odd(odd, none):
    known = {"en": b"the quick brown fox " * 9, "de": "der schnelle braune fuchs ".encode() * 9}
    got = {r["doc_id"]: r for r in language.identify(odd, known).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in known
    assert language.identify(none, {}).count() == 0 and language.learn(none) == {}
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}


# --- 3: sharding ------------------------------------------------------------------------------------------------------
def test_differencing():
    assert sharding.difference([], 4) == []
    # The classic instance: differencing two ways leaves a spread of 2.
    got = sharding.difference([8, 7, 6, 5, 4], 2)
    sums = [sum(x for x, s in zip([8, 7, 6, 5, 4], got, strict=True) if s == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100_000) for _ in range(3000)]
    got = sharding.difference(sizes, 16)
    sums = [sum(x for x, s in zip(sizes, got, strict=True) if s == k) for k in range(16)]
    assert max(sums) - min(sums) < 50


def check_shards(got, rows):
    assert len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    where = {}
    for r in got:
        where.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("max_items", [40_000, 300])
def test_shards(spark, max_items):
    rows = [(i, words(i % 700, 5 + i % 90), "en", "s", 0) for i in range(1000)] + [(5000 + i, "the same text", "en", "s", 0) for i in range(500)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, SCHEMA), max_items=max_items).collect()
    check_shards(got, rows)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= max(30, 0.02 * sum(sizes) / 16) or max_items == 300 and max(sizes) < 1.1 * sum(sizes) / 16
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["size"] == len(rows[3][1].encode()) + 1 and by_id[3]["text_crc32"] == zlib.crc32(rows[3][1].encode())


def test_shards_of_many_small_groups_are_even(spark):
    """Where groups are bundled, the bundles' sums still even out: 20,000 groups in 300 bundles, a group of a third of all rows."""
    rows = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text for a third of all rows', repeat(concat('w', id), 1 + id % 40)) as text")
    got = sharding.balanced_shards(rows, max_items=300).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    largest = 10_000 * (len("one text for a third of all rows") + 1)
    sums = sorted(r["n"] for r in got)
    others = [x for x in sums if x < largest] if sums[-1] == largest else sums
    assert len(sums) == 16 and max(others) - min(others) < 0.01 * sum(sums) / 16


def test_languages_have_no_cap(spark, monkeypatch):
    """With more languages than room every one is learned, from smaller dictionaries; repeated rows change nothing."""
    monkeypatch.setattr(language, "DICTIONARIES", 40 * 2048)
    rows = [(i, words(1000 + i % 40, 150, 120), f"l{i % 40:02d}", "s", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language.learn(docs)
    assert len(found) == 40 and all(len(x) <= 2048 for x in found.values())
    assert language.learn(docs.unionByName(docs).repartition(7)).keys() == found.keys()
    got = language.identify(docs, found).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() > 0.9 * len(rows)


def test_shards_odd(odd, none):
    got = sharding.balanced_shards(odd).collect()
    check_shards(got, ODD)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1} and {r["law"] for r in got} == {"bytes"}
    assert sharding.balanced_shards(none).count() == 0


# --- 4: vectors ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(1)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((800, 64)))
    near = []
    for c in (0.91, 0.95, 0.99):
        u = rng.standard_normal((150, 64))
        u = unit(u - (u * base[:150]).sum(1, keepdims=True) * base[:150])
        near.append(c * base[:150] + math.sqrt(1 - c * c) * u)
    hot = unit(rng.standard_normal(64)) + 0.02 * rng.standard_normal((200, 64))
    return np.concatenate([base, *near, hot, base[:20]]).astype(np.float32)


@pytest.mark.parametrize("split", [False, True])
def test_vectors(spark, planted, split, monkeypatch):
    if split:
        monkeypatch.setattr(vectors, "SPLIT_ROWS", 80)
        monkeypatch.setattr(vectors, "GROUP_ROWS", 64)
    monkeypatch.setattr(vectors, "FEW", 100)
    bad = [(9001, None), (9002, [0.0] * 64), (9003, [None] + [1.0] * 63), (9004, [float("nan")] + [1.0] * 63), (9005, [float("inf")] + [1.0] * 63), (9006, []), (9007, [1.0, 2.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(planted)] + bad
    got = sorted(vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))).collect())
    x = planted.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    n = s.sum(1)
    links = np.array([r["n_links"] for r in got[: len(n)]])
    assert len(got) == len(rows) and (links <= n).all() and links.sum() >= 0.98 * n.sum()
    label = components.forest(len(n), *np.nonzero(s))
    assert np.mean([r["component_id"] == b for r, b in zip(got, label, strict=False)]) > 0.98
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got[len(n) :])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def off_centre(norm, n, pairs, seed=3, dim=64):
    """Unit vectors whose mean has about this norm, and partners at cosine 0.90 to 0.91 of the first ones."""
    rng = np.random.default_rng(seed)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    x = unit(math.sqrt(1 - norm * norm) * unit(rng.standard_normal((n, dim))) + norm * unit(rng.standard_normal(dim)))
    u = rng.standard_normal((pairs, dim))
    u = unit(u - (u * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    c = rng.uniform(0.9, 0.91, (pairs, 1))
    return x, c * x[:pairs] + np.sqrt(1 - c * c) * u


@pytest.mark.parametrize("norm", [0.0, 0.8])
def test_vectors_off_centre(spark, norm):
    x, partners = off_centre(norm, 12_000, 1500)
    x = np.concatenate([x, partners]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    links = np.array([r["n_links"] for r in sorted(vectors.link_vectors(rows).collect())])
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    n = (x @ x.T >= 0.9).sum(1) - 1
    assert (links <= n).all() and links.sum() >= 0.98 * n.sum() and n.sum() >= 2900


@pytest.mark.parametrize(("norm", "n"), [(0.0, 20_000), (0.0, 10**6), (0.0, 10**9), (0.5, 10**6), (0.8, 10**6)])
def test_vector_tables_reach_recall(norm, n):
    """Pairs at a cosine of 0.9 exactly, other than those that were measured, for tables planned for three sizes."""
    x, _ = off_centre(norm, 20_000, 1)
    u = np.random.default_rng(9).standard_normal((3000, 64))
    u -= (u * x[:3000]).sum(1, keepdims=True) * x[:3000]
    partners = 0.9 * x[:3000] + math.sqrt(1 - 0.81) * u / np.linalg.norm(u, axis=1, keepdims=True)
    mean, project, bits, tables, radius = vectors.plan(x, n)
    on = lambda a: (a - mean) @ project > 0
    a, b = on(x[:3000]), on(partners)
    keys = lambda o: o[:, : tables * bits].reshape(len(o), tables, bits)
    found = (keys(a) == keys(b)).all(2).any(1) & ((a[:, : vectors.CODE] != b[:, : vectors.CODE]).sum(1) <= radius)
    print(f"recall {found.mean():.4f} with {tables} tables of {bits} bits for {n} vectors, mean norm {norm}")
    assert bits >= 5 and found.mean() >= 0.975 and tables <= 500


def test_vectors_all_pairs(spark, planted):
    """A recall of 1 is the exact way."""
    rows = [(i, v.tolist()) for i, v in enumerate(planted)]
    got = sorted(vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=1.0).collect())
    x = planted.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    assert [r["n_links"] for r in got] == s.sum(1).tolist() and [r["component_id"] for r in got] == components.forest(len(x), *np.nonzero(s)).tolist()


def test_vectors_of_several_lengths_and_of_repeated_or_null_ids(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPLIT_ROWS", 128)
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.1]
    rows = [(1, a), (1, b), (2, c), (3, [0.0, 2.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (6, [1e200, 1e190]), (7, [1e-200, 0.0]), (None, [0.0, 5.0]), (None, [-1.0, 0.0]), (8, [1.0])]
    got = sorted((tuple(r) for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 2, 1, True), (2, 3, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 3, 1, False), (7, 3, 1, False), (None, 2, 1, False), (None, 0, None, True), (8, 0, 8, True)], key=repr)
    many = [(i, np.random.default_rng(i % 200).standard_normal(2 + i % 3).tolist()) for i in range(900)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.link_vectors(spark.createDataFrame(many, "vec_id long, embedding array<double>")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in many}
    assert all(n == sum(len(unit[i]) == len(unit[j]) and i != j and unit[i] @ unit[j] >= 0.9 for j in unit) for i, n in got.items())


def test_vectors_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.link_vectors(empty).count() == 0


def test_rotation_balances_and_keeps_angles():
    x = np.random.default_rng(0).standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, w = vectors.learn(x, 32)
    bits = (x - mean) @ w > 0
    assert w.shape == (16, 32) and np.allclose(w[:, :16].T @ w[:, :16], np.eye(16), atol=1e-8)
    assert abs(bits.mean(0) - 0.5).max() < 0.06


# --- components ---------------------------------------------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)] + [(7, 7)]
    found = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    a, b = zip(*edges, strict=True)
    label = components.forest(3000, np.array(a), np.array(b))
    assert found == {v: label[v] for e in edges if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5: suffix arrays -----------------------------------------------------------------------------------------------------------
def brute_repeats(rows, n=suffixes.LENGTH):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if i is not None and first[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_rows():
    rng = random.Random(7)
    common = words(99, 30)
    rows = []
    for i in range(60):
        t = words(i, rng.randrange(0, 60), 60)
        if i % 3 == 0:
            t = t[: len(t) // 2] + common + t[len(t) // 2 :]
        if i % 5 == 0:
            t += "é漢" * rng.randrange(10, 40)
        if i % 7 == 0:
            t += "ab" * 60 + common[: rng.randrange(45, 60)]
        rows.append((rng.randrange(50), t))
    return rows + [(70, common), (71, common), (71, common), (72, common[:49]), (73, common[:50]), (None, common), (74, None), (75, ""), (0, common), (76, "x" * 600), (77, "x" * 300),
        (80, "abcde" * 9 + "abcd"), (81, "q" + "cdeab" * 60), (82, "bcdea" * 40 + "z" + common), (83, "de" + "abcde" * 30 + "r" * 55), (84, "r" * 49), (85, "er" * 70), (86, "re" * 26 + "r" * 60), (None, "er" * 70), (87, "abcde" * 2000)]


@pytest.mark.parametrize("sizes", [(6 << 20, 3 << 20, 4096, 1 << 18), (3000, 1500, 4096, 1 << 18), (3000, 1500, 2, 128)])
def test_repeats(spark, sizes, monkeypatch):
    for name, value in zip(("PART_BYTES", "BUCKET_BYTES", "HOT", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(suffixes, name, value)
    rows = repeated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in suffixes.remove_repeats(docs, digest_only=True).collect()), key=repr) == brute_repeats(rows)


def test_copies_on_one_id(spark):
    a, b = words(1, 20), words(2, 20)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b + a), (4, None), (4, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffixes.remove_repeats(docs, digest_only=True).collect()), key=repr)
    assert got == brute_repeats(rows) and sum(r[2] == 0 for r in got) == 3


def test_repeats_keep_columns_and_characters(spark, odd, none):
    docs = odd.select("*", F.lit("x").alias("blob"))
    got = suffixes.remove_repeats(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == len(ODD)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[1]["text"] is None and by_id[7]["text"] == ODD[7][1] and by_id[8]["text"] == "" and by_id[8]["n_removed"] == 300_000
    assert suffixes.remove_repeats(none).count() == 0 and suffixes.remove_repeats(none, digest_only=True).count() == 0
    shared = "字" * 40
    two = spark.createDataFrame([(1, "a" + shared + "b"), (2, "c" + shared + "d")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(two).collect()} == {1: "a" + shared + "b", 2: "cd"}


def test_refinement_names_equal_strings():
    data = (words(3, 300, 20) + "abab" * 60).encode()
    starts = np.arange(0, len(data) - 50)
    for q in (8, 25):
        found = suffixes.refine(data, starts, 50, q)
        by_text = {}
        for s, b in zip(starts.tolist(), found.tolist(), strict=True):
            assert by_text.setdefault(data[s : s + 50], b) == b
        assert len(by_text) == len(set(found.tolist()))


# --- 6: sentence pieces -------------------------------------------------------------------------------------------------------------
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces(spark, odd, none):
    got = {r["doc_id"]: r for r in sentence_pieces.encode_documents(odd, MODEL).collect()}
    assert all(r["parity"] and r["round_trip"] for r in got.values())
    assert got[1]["ids"] == [] and got[2]["n_ids"] == 0 and got[7]["n_ids"] > 60_000
    assert all(r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) for r in got.values())
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_documents(sentence_pieces.encode_documents(odd, MODEL), MODEL).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in ODD)
    assert sentence_pieces.encode_documents(none, MODEL).count() == 0


def test_piece_parity_on_awkward_texts():
    import sentencepiece

    raw = open(MODEL, "rb").read()
    ours, theirs = sentence_pieces.PieceEncoder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(6)
    signs = ["a", "the", " ", "  ", "\n", "\t", "é", "漢", "🎉", "1", "23", ",", "'s", "▁", "<s>", "<0x0A>", " ", "²", "Ж", "-", "A"]
    texts = ["", " ", "\n"] + ["".join(rng.choices(signs, k=rng.randrange(1, 25))) for _ in range(1500)]
    for t, ids in zip(texts, ours.encode_all(texts), strict=True):
        want = theirs.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert ours.tokenizer.encode(t, add_special_tokens=False).ids == want, t
        assert ours.decode(want) == t.replace("▁", " ")


def charsmap_of(rules):
    """A normaliser's rules (one byte: text) in the model's form: a double-array trie with one level, and the texts."""
    units, texts = [0] * 512, b""
    base = 256  # children of the root stand at base ^ byte
    units[0] = base << 10
    for k, (byte, text) in enumerate(rules.items()):
        leaf = base ^ byte
        value = 512 + k  # the key ends here: the child under byte 0 holds the value
        units.extend([0] * (value + 1 - len(units)))
        units[leaf] = ((leaf ^ value) << 10) | 1 << 8 | byte
        units[value] = 1 << 31 | len(texts)
        texts += text.encode() + b"\0"
    units.extend([0] * (-len(units) % 256))
    trie = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(trie)) + trie + texts


def unigram_model(byte_fallback=True, charsmap=b"", squeeze=0):
    """A model file made by hand: pieces with scores, byte pieces, and the spec fields that matter."""
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    whole = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
    number = lambda k, n: varint(k << 3) + varint(n)
    piece = lambda p, s, kind: whole(1, whole(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, kind))
    pieces = [piece("<unk>", 0, 2)] + ([piece(f"<0x{i:02X}>", -20.0, 6) for i in range(256)] if byte_fallback else [])
    pieces += [piece(p, s, 1) for p, s in (("▁", -3.0), ("▁a", -2.0), ("a", -3.5), ("b", -3.6), ("ab", -4.0), ("▁ab", -4.1), ("ba", -5.0), ("c", -6.0), ("▁the", -2.5))]
    return b"".join(pieces) + whole(2, number(3, 1) + number(35, int(byte_fallback)) + number(40, 0)) + whole(3, (whole(2, charsmap_of({ord("x"): "ab", ord("q"): "c"}) if charsmap == "own" else charsmap) if charsmap else b"") + number(3, 1) + number(4, squeeze))


@pytest.mark.parametrize(("byte_fallback", "charsmap", "squeeze"), [(True, b"", 0), (False, b"", 0), (True, b"", 1), (True, "own", 0), (False, "own", 1)])
def test_unigram_scores_and_byte_fallback(byte_fallback, charsmap, squeeze):
    import sentencepiece

    raw = unigram_model(byte_fallback, charsmap, squeeze)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ours = sentence_pieces.PieceEncoder(raw)
    texts = ["ab", "abab the cab", "aba  bb", "x the é", "", "a\nb", "  a  b  ", "qx xq zz z", " "]
    for t, ids in zip(texts, ours.encode_all(texts), strict=True):
        want = theirs.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        if byte_fallback:  # without it unknown characters are lost
            assert ours.decode(want) == theirs.decode(want) == ours.tokenizer.decode(want, skip_special_tokens=False), t


# --- 7: personal data -----------------------------------------------------------------------------------------------------------------
def hidden(docs):
    return pii.pseudonymise(docs, key=pii.EXAMPLE_KEY)


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def with_check(body):
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def feistel(key, kind, tweak, a, b, p, q):
    """The network again, in Python."""
    for i in range(pii.ROUNDS):
        f = lambda x: int(hashlib.sha256("|".join(map(str, (key, kind, tweak, i, x))).encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        a, b = ((a + f(b)) % p, b) if i % 2 == 0 else (a, (b + f(a)) % q)
    return a, b


def brute_card(m, key=pii.EXAMPLE_KEY):
    d = re.sub("[^0-9]", "", m)
    u, v = (len(d) - 1) // 2, (len(d) - 2) // 2
    a, b = feistel(key, "card", len(d), int(d[1 : 1 + u]), int(d[1 + u : 1 + u + v]), 10**u, 10**v)
    new = iter(with_check(f"{d[0]}{a:0{u}d}{b:0{v}d}"))
    return "".join(next(new) if c.isdigit() else c for c in m)


def test_card_and_ip_pseudonyms_match_python(spark):
    rng = random.Random(8)
    cards = [with_check("".join(rng.choices("0123456789", k=n))) for n in (12, 13, 14, 15, 16, 17, 18) for _ in range(20)]
    cards += [f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}" for c in cards if len(c) == 16]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)]
    rows = [(i, f"x {m} y") for i, m in enumerate(cards + ips)]
    got = {r["doc_id"]: r["text"] for r in hidden(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, m in enumerate(cards):
        assert got[i] == f"x {brute_card(m)} y" and luhn(re.sub("[^0-9]", "", got[i]))
    for i, m in enumerate(ips, len(cards)):
        o = list(map(int, m.split(".")))
        a, b = feistel(pii.EXAMPLE_KEY, "ip", 4, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        assert got[i] == f"x {a // 256}.{a % 256}.{b // 256}.{b % 256} y"


def unfeistel(kind, tweak, a, b, p, q, key=pii.EXAMPLE_KEY):
    """The network backwards."""
    for i in reversed(range(pii.ROUNDS)):
        f = lambda x: int(hashlib.sha256("|".join(map(str, (key, kind, tweak, i, x))).encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        a, b = ((a - f(b)) % p, b) if i % 2 == 0 else (a, (b - f(a)) % q)
    return a, b


def undo(kind, m):
    """The value that a pseudonym stands for, from its kind's domain alone."""
    d = re.sub("[^0-9]", "", m)
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        a, b = unfeistel(kind, 9, (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        area = a // 99 + 1
        new = f"{area + (area >= 666):03d}{a % 99 + 1:02d}{b + 1:04d}"
    elif kind == "phone":
        k = 10 if len(d) >= 10 else len(d) - 1
        u, v = (k + 1) // 2, k // 2
        a, b = unfeistel(kind, k, int(d[-k:][:u]), int(d[-v:]), 10**u, 10**v)
        new = f"{d[:-k]}{a:0{u}d}{b:0{v}d}"
    elif kind == "iban":
        n = len(d) - 2
        u, v = (n + 1) // 2, n // 2
        a, b = unfeistel(kind, n, int(d[2 : 2 + u]), int(d[-v:]), 10**u, 10**v)
        digits = iter(f"00{a:0{u}d}{b:0{v}d}")
        raw = "".join(next(digits) if c.isdigit() else c for c in m)
        flat = raw.replace(" ", "")
        rest = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97
        return f"{raw[:2]}{98 - rest:02d}{raw[4:]}"
    else:
        order = (0, 1, 2) if re.match("[0-9]{4}", m) else (2, 1, 0)
        parts = re.split("[-/.]", m)
        t = datetime.date(*(int(parts[k]) for k in order))
        century = t.year // 100
        p, q = (75, 487) if century % 4 == 0 else (92, 397)
        first = datetime.date(century * 100, 1, 1)
        days = (t - first).days
        a, b = unfeistel(kind, century, days // q, days % q, p, q)
        was = first + datetime.timedelta(a * q + b)
        new = was.strftime("%Y%m%d") if order[0] == 0 else was.strftime("%d%m%Y")
    digits = iter(new)
    return "".join(next(digits) if c.isdigit() else c for c in m)


def test_pseudonyms_can_be_undone(spark):
    """What Python undoes from pseudonyms alone are the values they stand for."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    values = [("ssn", f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 660)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}") for _ in range(60)]
    values += [("phone", x) for _ in range(20) for x in (f"({digits(3)}) {digits(3)}-{digits(4)}", f"+1 {digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(9)}", f"+4{digits(13)}")]
    for _ in range(30):
        account = "00" + "".join(rng.choices("0123456789", k=18))
        flat = "DE" + account
        flat = f"DE{98 - int(''.join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97:02d}{flat[4:]}"
        values += [("iban", flat), ("iban", " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)))]
    for _ in range(80):
        t = datetime.date(rng.choice([1000, 1582, 1600, 1899, 1900, 1999, 2000, 2024, 2099]), rng.randrange(1, 13), rng.randrange(1, 29))
        values += [("date", t.strftime("%Y-%m-%d").zfill(10)), ("date", f"{t.day:02d}/{t.month:02d}/{t.year}")]
    got = hidden(spark.createDataFrame([(i, f"x {m} y") for i, (_, m) in enumerate(values)], "doc_id long, text string")).collect()
    for r in got:
        kind, m = values[r["doc_id"]]
        new = r["text"][2:-2]
        assert r[f"n_{kind}"] == 1 and undo(kind, new) == m, (kind, m, new)
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.range(1))
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(spark.range(1).withColumn("text", F.lit("")), key="")


def test_permutations_are_one_to_one(spark):
    rows = [(0, " ".join(f"{i:03d}-{j:02d}-0001" for i in range(1, 40) for j in range(1, 20))), (1, " ".join(f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29))), (2, " ".join(f"(555) 000-{i:04d}" for i in range(300)))]
    for r in hidden(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        before, after = ({*re.findall(r"\(\d+\) [\d-]+|[\d-]+", t)} for t in (rows[r["doc_id"]][1], r["text"]))
        assert len(after) == len(before) and not before & after or len(before & after) < 4
        assert all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, b in zip(sorted(before), sorted(after), strict=True))


def test_pii_text(spark, odd, none):
    good = 'c 4111111111111111, +1 (017) 555-7713; 233.254.104.120!! a.b_19@mail5.example.com. 123-45-6789 2020-02-29 29.02.2020 12/31/1999 "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    bad = "4111111111111112 666-12-1234 2021-02-29 1.2.3 300.1.1.1 12345 version 2.0. x@y 1999-13-01"
    got = {r["doc_id"]: r for r in hidden(spark.createDataFrame([(1, good), (2, bad), (3, good)], "doc_id long, text string")).collect()}
    assert got[1]["text"] == got[3]["text"] and got[2]["text"] == bad
    private = ["4111111111111111", "(017) 555-7713", "233.254.104.120", "a.b_19@", "123-45-6789", "2020-02-29", "29.02.2020", "12/31/1999", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert all(x in good and x not in got[1]["text"] for x in private) and "+1 (" in got[1]["text"]  # the country code is no private value
    assert {k: got[1][f"n_{k}"] for k in pii.KINDS} == {"email": 1, "ip": 1, "date": 3, "ssn": 1, "phone": 1, "card": 1, "iban": 0, "secret": 1}
    other = pii.pseudonymise(spark.createDataFrame([(1, good)], "doc_id long, text string"), key="another's").first()
    assert other["text"] != got[1]["text"]
    rows = {r["doc_id"]: r for r in hidden(odd).collect()}
    assert rows[1]["text"] is None and all(rows[i]["text"] == t for i, t, *_ in ODD) and rows[5]["n_email"] == 0 and hidden(none).count() == 0
    assert hidden(odd).columns.count("n_email") == 1


def iban_rest(m):
    s = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_ibans_and_plain_phones(spark):
    rng = random.Random(13)
    ibans = []
    for country, n in (("DE", 18), ("GB", 18), ("FR", 23), ("NO", 11)):
        for _ in range(15):
            body = "".join(rng.choices("0123456789" if country != "GB" else "0123456789ABC", k=n))
            check = 98 - iban_rest(f"{country}00{body}")
            ibans.append(f"{country}{check:02d}{body}")
    ibans += [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in ibans]
    wrong = [x[:2] + f"{(int(x[2:4]) + 1) % 100:02d}" + x[4:] for x in ibans[:10]]
    phones = ["+17435553824", "+4420794609", "+12345678"]
    rows = list(enumerate([f"<{m}>" for m in ibans + wrong + phones]))
    got = {r["doc_id"]: r for r in hidden(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, m in enumerate(ibans):
        new = got[i]["text"][1:-1]
        assert new != m and iban_rest(new) == 1 and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", m) and got[i]["n_iban"] == 1
    k = len(ibans) // 2
    assert all(got[i]["text"].replace(" ", "") == got[i + k]["text"].replace(" ", "") for i in range(k))
    assert all(got[2 * k + i]["text"] == f"<{m}>" for i, m in enumerate(wrong))
    for i, m in enumerate(phones, 2 * k + len(wrong)):
        assert got[i]["n_phone"] == 1 and got[i]["text"] != f"<{m}>" and len(got[i]["text"]) == len(m) + 2
    same = hidden(spark.createDataFrame([(1, "+1 (743) 555-3824 +17435553824")], "doc_id long, text string")).first()["text"]
    one, two = same.rsplit(" ", 1)
    assert re.sub("[^0-9]", "", one) == re.sub("[^0-9]", "", two)


def test_pii_plan_has_no_python(spark, odd):
    plan = hidden(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 8: packing ----------------------------------------------------------------------------------------------------------------------
def best_sum(lengths, counts, room):
    """The greatest sum up to room, by trying all."""
    sums = {0}
    for x in lengths:
        sums |= {s + x * k for s in sums for k in range(counts[x] + 1) if s + x * k <= room}
    return max(sums)


def test_fullest():
    rng = random.Random(9)
    for _ in range(200):
        counts = {rng.randrange(1, 60): rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))}
        lengths, room = sorted(counts, reverse=True), rng.randrange(0, 120)
        got = packing.fullest(lengths, counts, room)
        assert all(k <= counts[x] for x, k in got.items()) and sum(x * k for x, k in got.items()) == best_sum(lengths, counts, room)


def test_plan_uses_everything_once():
    rng = random.Random(10)
    histogram = dict(Counter(rng.choices(range(1, 200), k=5000)))
    steps = packing.plan(histogram, 200)
    used = Counter()
    for times, got in steps:
        assert sum(x * k for x, k in got.items()) <= 200
        used.update({x: k * times for x, k in got.items()})
    assert used == histogram
    assert sum(t for t, _ in steps) <= 1.01 * sum(x * n for x, n in histogram.items()) / 200
    assert packing.plan({}) == []


def check_packing(got, docs, size=packing.MAX_TOKENS):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            piece = ids[at : at + size]
            want[i, k, at, len(piece), zlib.crc32(np.asarray(piece, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, odd, none):
    rows = [(i, words(i, 3 + i * 7 % 900)) for i in range(300)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = check_packing(got, rows)
    assert n <= math.ceil(sum(r["length"] for r in got) / packing.MAX_TOKENS) + 1
    check_packing(packing.pack_documents(odd).collect(), [(i, t) for i, t, *_ in ODD])
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_tokens_of_any_vocabulary(name):
    """A file whose rules are not those that units rest on is left to the library."""
    path = public_tokenizers.path(name)
    enc = word_tokens.WordEncoder(path)
    assert enc.split == (name == "word_bpe_49k.json")
    texts = ["Hello there, World's  end!", "", "a\n\nb 12", "É漢 <|endoftext|> x"] * 3
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_all(texts)] == want


def test_word_tokens_match_the_library():
    enc = word_tokens.WordEncoder(packing.vocabulary())
    rng = random.Random(11)
    signs = ["don't", "'s", "'", " ", "\n", "é", "É", "ß", "12", "a1b", "__", "!'", "…", "“x”", "漢", "İ", "²", "\x1c", " ", "Ж", "<|endoftext|>", "WORD", "ﬁ", "é"]
    texts = ["", " "] + ["".join(rng.choices(signs, k=rng.randrange(1, 12))) for _ in range(1500)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(enc.encode_all(texts)) == want


# --- 9: WARC ------------------------------------------------------------------------------------------------------------------------------
PAGES = "page_id long, url string, html string"


def test_warc(spark, tmp_path):
    same, small = "x" * 150, "y" * 99
    rows = [(i, f"http://h/{i}", words(i, 40)) for i in range(40)] + [(41, "http://a", same), (40, "u rl\r\nX: 1", same), (99, None, same), (50, "", small), (51, "", small), (60, "n", None), (61, "é", "é" * 80), (None, "q", same), (41, "again", same)]
    df = spark.createDataFrame(rows, PAGES).withColumn("kind", F.lit(7))
    root = str(tmp_path / "w")
    manifest = warc.write_archives(df, root, roll_bytes=2000, shard_bytes=4000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted((tuple(r) for r in warc.read_archives(spark, root).collect()), key=repr)
    first = min(i for i, _, h in rows if h == same and i is not None)
    want, told = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0], hashlib.sha256((r[2] or "").encode()).digest(), r[1] or "")):
        raw = (h or "").encode()
        again = len(raw) >= 100 and h == same and i is not None and not (i == first and first not in told)
        told.add(i if again is False and h == same else None)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    files = sorted(p.name for p in (tmp_path / "w").glob("*.warc.gz"))
    again = str(tmp_path / "v")
    warc.write_archives(df.repartition(3), again, roll_bytes=2000, shard_bytes=4000)
    assert files == sorted(p.name for p in (tmp_path / "v").glob("*.warc.gz")) and not (tmp_path / "w" / "_temporary").exists()
    for name in files:
        assert (tmp_path / "w" / name).read_bytes() == (tmp_path / "v" / name).read_bytes()
        raw = gzip.decompress((tmp_path / "w" / name).read_bytes())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert json.loads((tmp_path / "w" / "_COMMITTED").read_text())["shards"] > 1
    records = [warc.parse_record(x) for name in files for x in warc._members((tmp_path / "w" / name).read_bytes())]
    responses = {r["warc-record-id"]: r["warc-payload-digest"] for r in records if r["warc-type"] == "response"}
    assert len({r["warc-record-id"] for r in records}) == len(records)
    for r in records:
        if r["warc-type"] == "revisit":
            assert responses[r["warc-refers-to"]] == r["warc-payload-digest"] and r["warc-profile"].endswith("identical-payload-digest") and r["warc-refers-to-date"] == r["warc-date"]


def test_warc_shards_of_skewed_ids(spark, tmp_path):
    """Ids that lie close but for one, and null ids, spread over shards of about equal bytes."""
    rows = [(10**15 if i == 400 else i if i < 400 else None, f"http://h/{i}", words(i, 60)) for i in range(600)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "s"), shard_bytes=80_000)
    sizes = {}
    for r in manifest.collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["records"]
    assert len(sizes) >= 8 and max(sizes.values()) < 2 * len(rows) / len(sizes) and sum(sizes.values()) == len(rows)
    assert warc.read_archives(spark, str(tmp_path / "s")).count() == len(rows)


def test_warc_revisit_without_response(spark, tmp_path):
    root = tmp_path / "r"
    warc.write_archives(spark.createDataFrame([(1, "u", "z" * 200), (2, "u", "z" * 200)], PAGES), str(root))
    (name,) = (p.name for p in root.glob("*.warc.gz"))
    kept = [warc._member(x) for x in warc._members((root / name).read_bytes()) if b"WARC-Type: response" not in x]
    (root / name).write_bytes(b"".join(kept))
    (root / f".{name}.crc").unlink(missing_ok=True)
    for p in (root / "manifest").iterdir():
        if p.name.startswith("part"):
            p.write_text(p.read_text().replace('"records":2', '"records":1'))
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="not there"):
        warc.read_archives(spark, str(root)).collect()


def test_warc_rejects_damage(tmp_path, spark):
    raw = gzip.decompress(warc.make_record(1, "http://x", b"payload", None, 0))
    assert warc.parse_record(raw)["block"].endswith(b"payload")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"payload", b"pAyload"))
    empty = spark.createDataFrame([], PAGES)
    warc.write_archives(empty, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


# --- 10: SimHash ----------------------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    texts = [t for _, t, *_ in ODD if len(t or "") < 100] + [words(i, i) for i in range(60)] + ["A B C", "a b c"]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "BLOCK", 7)
    blocks = lambda d: list(simhash.word_blocks(d, 7))
    assert [x for b in blocks(b"aa bb  cc\ndddddddddd e ") for x in b] == [b"aa", b"bb", b"cc", b"dddddddddd", b"e"]


@pytest.mark.parametrize("limits", [(2048, 16384), (8, 20)])
def test_near_links(spark, limits, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limits[0])
    monkeypatch.setattr(simhash, "SPLIT_ROWS", limits[1])
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base) | {0, (1 << 64) - 1, 1 << 63}
    for b in base[:60]:
        for flips in range(1, 6):
            x = b
            for k in rng.sample(range(64), flips):
                x ^= 1 << k
            fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(signed))
    found = {r["vertex"]: r["root"] for r in components.components(links).collect()}
    a = np.array(signed)
    label = components.forest(len(a), *np.nonzero(np.bitwise_count((a[:, None] ^ a[None]).view(np.uint64)) <= 3))
    groups = {}
    for x, k in zip(signed, label, strict=True):
        groups.setdefault(k, set()).add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(v for v, r in found.items() if r == root) for root in set(found.values())}


def test_near_duplicates(spark, odd, none):
    t = words(1, 400)
    rows = [(9, t), (4, t.upper()), (7, t + " tail"), (3, words(2, 400)), (2, None), (8, "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == got[4] == 4 and got[3] == 3 and got[2] == got[8] == 2
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(none).count() == 0


def jaccard(a, b, width=5):
    def shingles(text):
        w = [x.lower() for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts, similarity=0.8):
    """For ids and texts: the smallest id reachable over links of that similarity."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and find(i) != find(j) and jaccard(texts[i], texts[j]) >= similarity:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}


def changed(text, seed, n):
    """`text` with n words changed."""
    w, rng = text.split(), random.Random(seed)
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("limits", [{}, {"SPLIT_ROWS": 8, "GROUP_BYTES": 4000, "TILE": 4, "COLUMNS": 64, "LEADERS": 2}])
def test_similar_documents(spark, limits, monkeypatch):
    """Groups equal those of all pairs' similarities, for pairs around the threshold, chains, hot groups and short texts."""
    for k, v in limits.items():
        monkeypatch.setattr(similar, k, v)
    texts = {i: words(i, 40 + 10 * i, 3000) for i in range(40)}
    for i in range(40):
        for k in range(3):  # 5 words of shingles go with each changed word
            texts[100 + 3 * i + k] = changed(texts[i], 3 * i + k, 1 + k * len(texts[i].split()) // 60)
    hot = words(99, 300, 3000)
    texts |= {1000 + k: changed(hot, k, 2 + k % 6) for k in range(60)}
    short = ["", " ", None, "a", "A", "a b c d", "a b c d e", "a b c d e f", "a b c d f"]
    texts |= {2000 + k: x for k, x in enumerate(short)}
    got = {r["id"]: r["group"] for r in similar.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    want = brute_groups(texts)
    assert {(i, j) for i in want for j in want if got[i] == got[j]} == {(i, j) for i in want for j in want if want[i] == want[j]}


def test_similar_documents_recall():
    """Share of pairs at a similarity of 0.8 that meet in a key and lie within the radius."""
    rng = np.random.default_rng(1)
    found = 0
    for k in range(400):
        n = int(rng.choice([9, 45, 450, 1800]))  # two sets of n hashes, of which 8 of 10 in all are in both
        h = rng.integers(0, 1 << 63, n * 10 // 9, np.uint64)
        (fa, ka), (fb, kb) = similar.sketch(h[:n]), similar.sketch(h[-n:])
        assert len(np.intersect1d(h[:n], h[-n:])) / len(h) >= 0.79
        found += bool((ka == kb).any()) and sum((x ^ y).bit_count() for x, y in zip(fa, fb, strict=True)) <= similar.RADIUS
    assert found >= 396


def test_similar_documents_odd(odd, none):
    got = similar.similar_documents(odd).collect()
    group = {}
    for r in got:
        group.setdefault(r["id"], set()).add(r["group"])
    assert len(got) == len(ODD) and group[1] == group[2] == group[3] and group[7] == group[8] and len(group[5]) == 1 and group[4] != group[5]
    assert similar.similar_documents(none).count() == 0
    twice = odd.sparkSession.createDataFrame([(1, words(1, 50)), (1, words(2, 50)), (2, words(2, 50) + " x"), (3, words(1, 50))], "doc_id long, text string")
    assert len({r["group"] for r in similar.similar_documents(twice).collect()}) == 2


def test_blocks():
    for n, tables, bits in ((0, 4, 0), (2048, 4, 0), (10**6, 4, 9), (2 * 10**8, 10, 17), (10**11, 20, 26)):
        blocks, m, used = simhash._blocks(n, 3)
        assert (math.comb(len(blocks), m), used) == (tables, bits) and sum(w for _, w in blocks) == 64
        assert len(blocks) - 3 == m and used <= sum(sorted(w for _, w in blocks)[:m])


@pytest.mark.parametrize(("n", "radius"), [(0, 3), (3 * 10**8, 3), (10**11, 3), (0, 6)])
def test_near_links_lose_nothing(spark, n, radius):
    """Whatever the number of tables: pairs within the radius are connected, others are not."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for x in list(fps):
        for bits in (radius, radius + 1):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [x - (1 << 64) * (x >> 63) for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), n or len(signed), radius)
    got = {r["vertex"]: r["root"] for r in components.components(links).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert want and all(got[a] == got[b] for a, b in want) and len(got) == len({x for p in want for x in p})
