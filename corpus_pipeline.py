"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of `documents`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import packing, pii, quality, similar, suffixes
from lectern.llm._shared import column, new_path, remove, row_key
from lectern.plans.session import ship


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with the key that verdicts are told by, and its name: ids may be null or repeated, so the key covers id, text,
    language and source."""
    name = "row_key" + "_" * max(map(len, docs.columns))  # longer than any name there
    return docs.withColumn(name, row_key(docs, "doc_id", "text", "lang", "source")), name


def _only(docs: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """Rows of `docs` whose key stands in kept (column id)."""
    return docs.join(kept.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def _plain(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(column(docs, c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and blank texts fail the base rules and go; a null or repeated id, language or source is a value like any other, and rows
    of one id have verdicts of their own; no documents give none; columns beyond those of `documents` are kept.
    """
    ship(spark)
    keyed, key = _keyed(docs)
    kept = quality.judge(keyed, id_col=key).where("kept").select(F.col("doc_id").alias("id"))
    return _plain(_only(keyed, key, kept), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one document: that with the smallest id.

    Of equal ids in a group, and of rows equal in id, text, language and source, one stays; null ids come last. Null and
    blank texts equal each other; no documents give none; columns beyond those of `documents` are kept.
    """
    ship(spark)
    keyed, key = _keyed(docs)
    groups = similar.similar_documents(keyed.select(key, "text"), id_col=key)
    ids = groups.join(keyed.select(F.col(key).alias("id"), "doc_id").distinct(), "id")
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first"))
    return _plain(_only(keyed, key, first.select("first.id")).dropDuplicates([key]), docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 bytes that an earlier one has; n_chars follows the text.

    Null texts stay null; rows with a null id lose nothing, rows of one id are not earlier than each other; no documents give none;
    columns beyond those of `documents` are kept.
    """
    ship(spark)
    left = suffixes.remove_repeats(docs)
    return _plain(left.withColumn("n_chars", F.length("text").cast("long")), docs.columns)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms; n_chars follows the text.

    Null and empty texts stay as they are; ids play no part; no documents give none; columns beyond those of `documents` are kept.
    """
    done = pii.pseudonymise(docs, key=pii.EXAMPLE_KEY, counts=False)
    return _plain(done.withColumn("n_chars", F.length("text").cast("long")), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences.

    A null text counts as empty and is one piece of the end id; rows of equal or null ids are separate documents; no documents
    give no pieces; other columns are left out.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pii_pseudonyms", pii_pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the fit, the fingerprints, nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. A stage's folder goes once the next one is written; the last
    folder stays, as the result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            remove(spark, done)
        done = path
    return STAGES[-1][1](spark, docs, sf_dir)
