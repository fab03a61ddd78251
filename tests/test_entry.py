from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

ROOT = Path(__file__).resolve().parents[1]
SLOW = {"segment_documents"}
OWN = [n for n in entry_point.oracle_sql() if not n.startswith("op") and n not in SLOW]


def rows_of(data, columns):
    plain = lambda v: None if v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in data)


@pytest.mark.parametrize("name", OWN)
def test_queries_equal_their_sql(spark, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(entry_point.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_the_rest_works_without_the_text_operators(tmp_path):
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or rel.parts[0] == "tests":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(p.read_text())
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession

q = e.queries()
assert 'parse_result' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)
e.oracle_sql()
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert q['segment_documents'](spark, '/root/testdata/sf0.001').count() == 200 and q['flag_names'](spark, '').count() == 512
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
