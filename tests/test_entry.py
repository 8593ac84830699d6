"""The driver contract, and the SQL twins on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_twins_agree(spark):
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    from quillspark.plans import catalog

    queries, sql, wrong = catalog.queries(), catalog.sql(), []
    for name in sorted(sql):
        df = queries[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
        r = con.execute(sql[name])
        names = [d[0] for d in r.description]
        want = sorted(repr(tuple(plain(x[names.index(c)]) for c in columns)) for x in r.fetchall())
        if got != want:
            wrong.append(name)
    assert not wrong


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [["quillspark/llm", "tests/llm"], ["quillspark/llm", "tests/llm", "corpus_pipeline.py"]])
def test_works_without_the_optional_subpackage(tmp_path, gone):
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: {n for n in names if n in (".git", "__pycache__") or str((Path(d) / n).relative_to(root)) in gone})
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'WN17_segment_summary' in q; assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
