"""The driver's contract: queries run, agree with their SQL, and stand without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    got = entry.queries()[name](spark, D).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    assert rows(got) == rows(con.sql(sql).df())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_without_llm(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "lectern"), tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):  # the pipeline cannot be imported without the folder
            shutil.copy(os.path.join(root, name), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    n, any_op, n_sql = out.stdout.split()
    assert int(n) > 60 and any_op == "False" and int(n_sql) > 60


def test_a_library_is_missing(tmp_path):
    """Without a library that the training-data part needs, the other queries stay."""
    (tmp_path / "zstandard.py").write_text("raise ImportError('blocked')")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"})
    n, any_op, n_sql = out.stdout.split()
    assert int(n) > 60 and any_op == "False" and int(n_sql) > 60


def test_core_runs_without_llm(tmp_path):
    """The flagship query in a tree that has neither the folders nor the pipeline."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "lectern"), tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = (
        "from pyspark.sql import SparkSession; import __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', e.entry(s).count(), e.queries()['prefer_v3'](s, '/root/testdata/sf0.001').count() > 0)"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert "rows 1 True" in out.stdout
