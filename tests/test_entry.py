"""The driver's entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(sum(x.startswith('op') and x[2].isdigit() for x in q), 'pipeline' in q, len(q), set(o) <= set(q))"


def _run(cwd):
    return subprocess.run([sys.executable, "-c", COUNT], cwd=cwd, env={**os.environ, "PYTHONPATH": cwd}, capture_output=True, text=True)


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "no pipeline"])
def test_entry_without_the_corpus_operators(tmp_path, left):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(f"{copy}/labelwright/llm", ignore_errors=True)
    shutil.rmtree(f"{copy}/tests/llm", ignore_errors=True)
    if left == "an empty folder":
        os.makedirs(f"{copy}/labelwright/llm/__pycache__")
    if left == "no pipeline" and os.path.exists(f"{copy}/corpus_pipeline.py"):
        os.remove(f"{copy}/corpus_pipeline.py")
    got = _run(copy)
    assert got.returncode == 0, got.stderr
    operators, pipeline, n, known = got.stdout.split()
    assert operators == "0" and pipeline == "False" and int(n) >= 74 and known == "True"


def test_errors_inside_an_operator_are_errors(tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    os.makedirs(f"{copy}/labelwright/llm", exist_ok=True)
    for name in ("__init__.py", "queries.py"):
        with open(f"{copy}/labelwright/llm/{name}", "w") as f:
            f.write("import no_such_module\n" if name == "queries.py" else "")
    got = _run(copy)
    assert got.returncode != 0 and "no_such_module" in got.stderr
