import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_package(tmp_path):
    """With ``llm`` taken away, with or without the pipeline's file, the other queries are all there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.pyc", "tests"))
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    for keep in (True, False):
        if not keep:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-B", "-c", say], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": ""}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        queries, answers, pipeline = done.stdout.split()
        assert int(queries) == int(answers) >= 150 and pipeline == "False"
