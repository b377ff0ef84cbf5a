"""The entry module and its queries."""

from __future__ import annotations

import importlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["a1_use", "b7_keep_if", "c1_merge_1_1", "d9_collapse", "d6_tabulate", "e4_rank", "h24_mod", "j1_ols_simple", "l4_twfe", "m1_histogram"]


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    got = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted(tuple("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert key([[r[c] for c in names] for r in df.collect()]) == key(got.fetchall())


def test_imports_without_the_llm_folders():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tabulon.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q) and 'd9_collapse' in q"
    root = importlib.import_module("__spark_entry__").__file__.rpartition("/")[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_streams_take_stateless_operators(spark, tmp_path):
    from pyspark.sql import functions as F

    from tabulon.operators.columns import generate, keep_if
    from tabulon.streaming.stateless import check_stateless, each_batch

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    out = check_stateless(generate(keep_if(stream, F.col("id") > 4), "twice", F.col("id") * 2))
    q = each_batch(out, lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("twice")).first()[0] == 70
    with pytest.raises(ValueError):
        check_stateless(stream.groupBy("id").count())
