"""The driver's entry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = """
import __spark_entry__ as e
q = e.queries()
assert set(e.oracle_sql()) <= set(q)
assert not [n for n in q if n.startswith('op') or n == 'pipeline'] and 'wall_pca_segments' in q
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
print('ROWS', e.entry(s).count())
"""


@pytest.mark.parametrize("gone", [["strataplan/llm", "tests/llm", "corpus_pipeline.py"], ["strataplan/llm", "tests/llm"]])
def test_without_training_data(tmp_path, gone):
    """Everything else imports and runs, whether or not the pipeline's file is left behind."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    code = SAY if "corpus_pipeline.py" in gone else SAY.split("from pyspark")[0]
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    if "corpus_pipeline.py" in gone:
        assert "ROWS 7" in out.stdout


def test_errors_are_not_swallowed(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    package = copy / "strataplan" / "llm"
    package.mkdir(exist_ok=True)
    (package / "__init__.py").touch()
    (package / "queries.py").write_text("import no_such_module")
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode and "no_such_module" in out.stderr
