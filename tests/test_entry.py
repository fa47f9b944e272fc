"""The entry module where the training-data package or the pipeline has been left out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


@pytest.mark.parametrize("package, pipeline, leftovers", [(False, False, False), (False, True, False), (False, True, True)])
def test_entry_without_optional_parts(tmp_path, package, pipeline, leftovers):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    if leftovers:  # an empty folder is still a package to Python
        (tmp_path / "copy/textveil/llm/__pycache__").mkdir(parents=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path / "copy")}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, sql, has_llm = out.stdout.split()
    assert int(n) > 150 and int(sql) > 150 and has_llm == "False"


def test_entry_reports_other_missing_modules(tmp_path):
    """Only the optional parts themselves may be missing, not what they import."""
    (tmp_path / "textveil/llm").mkdir(parents=True)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(f"{ROOT}/textveil", tmp_path / "textveil", ignore=skip, dirs_exist_ok=True)
    (tmp_path / "textveil/llm/__init__.py").write_text("")
    (tmp_path / "textveil/llm/queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_module" in out.stderr
