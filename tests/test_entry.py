import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_parts(tmp_path):
    """The entry module has to work where the optional folders are gone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('pixelloom.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'blur' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")
def test_raster_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pixelloom import catalog

    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")

    def rows(names, data):
        order = sorted(range(len(names)), key=names.__getitem__)
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)

    for name, sql in catalog.SQL.items():
        got, want = catalog.QUERIES[name](spark, str(DATA)), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name
