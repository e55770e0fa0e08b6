"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quietframe import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"create view {t[:-8]} as select * from '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    columns = sorted(df.columns)
    near = lambda row: str(tuple(round(v, 6) if isinstance(v, float) else v for v in row))
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql})")
    assert sorted(near([r[c] for c in columns]) for r in rows) == sorted(map(near, want.fetchall()))


def test_entry_without_text_operators(tmp_path):
    """The driver's entry works when the text operators are gone."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/quietframe", tmp_path / "quietframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'count_grouped' in names and 'pipeline' not in names and not any(n.startswith('op1') for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_grouped_distance_passes_all_groups(spark, monkeypatch):
    """The whole customer table goes through the metric, not the first nations alone."""
    seen, distance = [], catalogue.IfGroupedBy.distance
    monkeypatch.setattr(catalogue.IfGroupedBy, "distance", lambda self, one, two, domain: seen.append(one.count()) or distance(self, one, two, domain))
    catalogue.queries()["grouped_distance"](spark, DIR).collect()
    assert seen == [spark.read.parquet(f"{DIR}/customer.parquet").count()]
