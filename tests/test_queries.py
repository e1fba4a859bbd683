"""Every query of the library that has SQL gives what DuckDB gives, on the smallest tables; and the library stands without the llm folders."""

import subprocess
import sys
from pathlib import Path

import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TOP = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(rows):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr([show(x) for x in v]) if isinstance(v, list) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(tuple(r) for r in got.select(*columns).collect()) == normal(want.fetchall())


def test_import_without_the_llm_folders(tmp_path):
    import shutil

    shutil.copytree(TOP / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
