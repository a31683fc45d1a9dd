"""The registered queries over whole tables, the pipeline's stages against brute force, and the SQL of those that have one."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lectern.llm import packing, pii, quality

from .test_operators import brute_groups, brute_repeats, check_packing

D = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert all(sum(bool(re.match(rf"op{n}_", k)) for k in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "pii_pseudonyms", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if re.match("op", k)))
def test_whole_tables(spark, name):
    got = entry.queries()[name](spark, D).toPandas()
    table = {"op4_vectors": "embeddings", "op9_warc": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{D}/{table}.parquet").count()
    assert len(got) == n or name == "op8_packing" and got["doc_id"].nunique() == n
    if sql := entry.oracle_sql().get(name):
        con = duckdb.connect()
        con.sql(f"create view {table} as select * from '{D}/{table}.parquet'")
        want = con.sql(sql).df()
        assert sorted(map(repr, got[sorted(got)].astype(object).where(got[sorted(got)].notna(), None).values.tolist())) == sorted(map(repr, want[sorted(want)].astype(object).where(want[sorted(want)].notna(), None).values.tolist()))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        at[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "best_fit_packing" or docs.columns == columns
    before, after = at["quality_rules"]
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(before, spark.read.parquet(f"{D}/documents.parquet").schema)).collect()}
    assert {r["doc_id"] for r in after} == {k for k, v in verdict.items() if v} and 0 < len(after) < len(before)
    before, after = at["simhash_near_dedup"]
    assert {r["doc_id"] for r in after} == set(brute_groups({r["doc_id"]: r["text"] for r in before}).values())
    before, after = at["suffix_array_dedup"]
    want = {r[0]: r for r in brute_repeats([(r["doc_id"], r["text"]) for r in before])}
    for r in after:
        assert len(r["text"].encode()) >= want[r["doc_id"]][1] - want[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
        if r["text"].isascii():
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][4]
    before, after = at["pii_pseudonyms"]
    old = {r["doc_id"]: r["text"] for r in before}
    private = re.compile(r"[\w.]+@[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b")
    assert len(after) == len(before)
    for r in after:
        assert not set(private.findall(old[r["doc_id"]])) & set(private.findall(r["text"]))
        if not re.search("[0-9@]", old[r["doc_id"]]):
            assert r["text"] == old[r["doc_id"]]
    before, after = at["best_fit_packing"]
    check_packing(after, [(r["doc_id"], r["text"]) for r in before], packing.MAX_TOKENS)
    assert pii.PATTERN


def test_stages_with_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns and no rows at all pass through every stage."""
    from .test_operators import ODD, SCHEMA, words

    good = [(100 + i, words(i, 120), "en", "a", 0) for i in range(60)] + [(None, words(500, 120), "en", "a", 0), (None, words(500, 120), None, None, None)]
    rows = spark.createDataFrame(ODD + good, SCHEMA).selectExpr("*", "1 as kept", "'x' as component_id")
    for name, docs in (("odd", rows), ("none", rows.where("doc_id < 0"))):
        columns = docs.columns
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, docs, D).write.parquet(str(tmp_path / name / step))
            docs = spark.read.parquet(str(tmp_path / name / step))
            if step == "quality_rules" and name == "odd":
                assert {r["doc_id"] for r in docs.collect()} >= {None, *range(100, 160)}
            assert step == "best_fit_packing" or docs.columns == columns
        assert (docs.count() > 60) == (name == "odd")


def test_rows_of_one_id_have_their_own_verdicts(spark):
    from .test_operators import SCHEMA, words

    good = words(1, 120)
    rows = [(i, words(100 + i, 120), "en", "a", 0) for i in range(60)] + [(7, "junk", "en", "a", 0), (900, good, "en", "a", 0), (900, good, "en", "a", 0), (901, good, "en", "a", 0), (900, words(2, 120), "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row_key": F.lit(1), "a.b": F.lit(2)})
    kept = corpus_pipeline.quality_rules(spark, docs, D)
    assert kept.columns == docs.columns and kept.count() == 64 and kept.where("doc_id = 7").count() == 1
    once = corpus_pipeline.simhash_near_dedup(spark, kept, D)
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == [*range(60), 900, 900]


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 50
