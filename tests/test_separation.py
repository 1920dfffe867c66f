"""The corpus subpackage and the pipeline can be deleted."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"


@pytest.mark.parametrize("gone", [["grainworks/llm", "tests/llm"], ["grainworks/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_stands_without_the_corpus_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True).stdout
    total, corpus, extra = out.split(" ", 2)
    assert int(total) - int(corpus) >= 36 and extra.strip() == "[]"
    assert int(corpus) == 0 or gone == ["corpus_pipeline.py"]
