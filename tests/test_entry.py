import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.catalog import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = [n for n, q in QUERIES.items() if q.sql]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        t = name.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{name}{'/*.parquet' if os.path.isdir(f'{DATA}/{name}') else ''}'")
    return con


def cells(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@needs_data
@pytest.mark.parametrize("name", SMALL)
def test_query_against_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = cells(tuple(r) for r in df.select(*cols).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == cells(rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rest_works_without_the_subpackage(tmp_path):
    """A copy without the llm folders and corpus_pipeline.py still imports and lists the other queries."""
    import shutil

    shutil.copytree(f"{ROOT}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'real_work_by_project' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
