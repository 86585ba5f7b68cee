import importlib
import os
import re
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark, small):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    assert e.entry(spark).columns == ["symbol_id", "root", "depth", "endless", "path"]


@pytest.mark.parametrize("name", ["p5_found", "p5_hierarchy", "a07_scores", "a10_hotspots", "g10_upstream", "j07_file_diff", "q02_search_specs", "w01_change_state", "u05_dependency_sets"])
def test_sql_agrees(spark, small, name):
    import duckdb

    import __spark_entry__ as e

    db = duckdb.connect()
    for file in os.listdir(small):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{small}/{file}'")
    got = e.queries()[name](spark, small)
    want = db.execute(e.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(r) for r in want.fetchall())


def test_core_does_not_need_the_text_operators():
    code = "import sys; sys.modules['quern.llm'] = None\nimport importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('quern.llm') else real(n, *a)\nimport __spark_entry__ as e\nassert 'p5_found' in e.queries() and not any(q.startswith('p1_') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    for folder, _, files in os.walk(os.path.join(ROOT, "quern")):
        if os.path.basename(folder) == "llm":
            continue
        for file in files:
            if file.endswith(".py"):
                assert not re.search(r"^\s*(?:from|import)\s+quern\.llm", open(os.path.join(folder, file), encoding="utf-8").read(), re.M), file
    importlib.invalidate_caches()
