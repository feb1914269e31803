import duckdb
import pytest

from newsloom import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted(map(repr, (tuple(r) for r in got.select(columns).toPandas().itertuples(index=False, name=None))))
    if name not in registry.oracle_sql():
        assert mine
        return
    want = db.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(want.columns) == columns
    assert mine == sorted(map(repr, want[columns].itertuples(index=False, name=None)))


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).parents[1]
    shutil.copytree(top / "newsloom", tmp_path / "newsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    n, pipeline, m = out.stdout.split()
    assert int(n) > 30 and pipeline == "False" and int(m) > 25
