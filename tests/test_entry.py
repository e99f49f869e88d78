import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["agg05_category_statistics", "scl12_timeline_dates", "jn09_located_entities", "sco01_completeness", "ups12_rolled_back", "dq20_classified", "er01_duplicate_candidates"]


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.columns and df.count() >= 0


def test_every_query_has_check_sql_or_a_reason():
    without = set(e.queries()) - set(e.oracle_sql())
    # fitted models, sketches and tokenizers are held against brute force in their own tests
    assert all(re.match(r"op\d+_|pipeline$", q) for q in without)
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(e.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    order = sorted(cols)
    want = sorted(str([r[cols.index(c)] for c in order]) for r in cur.fetchall())
    got = sorted(str([r[c] for c in order]) for r in e.queries()[name](spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_lives_without_the_training_data_package(tmp_path, with_pipeline):
    """A copy of the tree without the package (and with or without the pipeline) imports in a new process and has all other queries."""
    root = os.path.dirname(os.path.abspath(e.__file__))
    skipped = lambda folder, names: [n for n in names if n in (".git", "__pycache__", "spark-warehouse") or n == "llm"]
    copy = shutil.copytree(root, tmp_path / "copy", ignore=skipped)
    if not with_pipeline:
        (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e, bench; print(*sorted(e.queries())); assert set(e.oracle_sql()) == set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out == sorted(q for q in e.queries() if not re.match(r"op\d+_|pipeline$", q))
