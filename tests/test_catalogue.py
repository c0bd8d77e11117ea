"""The driver's contract: names, and that the add-on's absence is no error."""

import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_every_oracle_has_a_query():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert len(names) > 45


def test_the_rest_imports_without_the_add_on(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'validate_invoice' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_queries_have_wide_projections_in_small_methods(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    __spark_entry__.queries()["map_import"](spark, __spark_entry__.SMOKE_DIR)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
