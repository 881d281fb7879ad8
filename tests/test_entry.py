"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()), any(x.startswith('op') for x in e.queries()))"


def listed(folder):
    return subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_without_operators(tmp_path):
    for x in ("__spark_entry__.py", "glyphflow"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "glyphflow" / "llm", ignore_errors=True)
    said = listed(tmp_path)
    assert said.returncode == 0, said.stderr
    n, pipeline, oracles, operators = said.stdout.split()
    assert int(n) > 60 and (pipeline, oracles, operators) == ("False", "True", "False")
    # A file that is there but broken is an error.
    (tmp_path / "glyphflow" / "llm").mkdir()
    (tmp_path / "glyphflow" / "llm" / "__init__.py").write_text("import nothing_of_that_name")
    said = listed(tmp_path)
    assert said.returncode and "nothing_of_that_name" in said.stderr


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["doc_id", "out"]
