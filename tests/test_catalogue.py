"""Every query of the catalogue against its SQL in DuckDB, by value and type."""

import duckdb
import pytest

from spindrift.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [{k: _plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    if name not in catalogue.oracle_sql():
        assert rows
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == dict(zip(want.columns, map(str, want.types), strict=True))
    expected = [dict(zip(want.columns, map(_plain, r), strict=True)) for r in want.fetchall()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_llm(tmp_path):
    """A copy without the folders of the training-data operators still imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "spindrift", tmp_path / "spindrift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'topk_citations' in q and not any(k.startswith('op') for k in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})


def test_plans(spark):
    """What the scans read, and how the top is taken."""
    explain = lambda df: df._jdf.queryExecution().toString()
    plan = explain(catalogue.queries()["token_estimate"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan.split("Physical Plan")[-1]
    plan = explain(catalogue.queries()["spread_flag"](spark, SF))
    assert "TakeOrderedAndProject" in plan
    plan = explain(catalogue.queries()["chunk_pack"](spark, SF))
    assert plan.split("Physical Plan")[-1].count("Exchange") <= 1  # the conversations' own; packing adds none
