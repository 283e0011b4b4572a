"""Every registered query of the engine itself against its SQL, on whole small tables."""

import pytest

from compare import connection, difference
from loamgrid.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    found = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert difference(found, con, ORACLE_SQL[name]) == ""
    else:
        assert found.count() > 0


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The rest of the library stands without the folder of corpus operators and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "loamgrid", tmp_path / "loamgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
