"""Every query of the catalogue against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not SF.exists():
        pytest.skip("tables are not here")
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    f = float(v)
    return None if math.isnan(f) else round(f, 5) + 0.0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in catalogue.ORACLE:
        cur = con.execute(catalogue.ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)


def test_entry_survives_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).parent.parent
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 40 and e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
