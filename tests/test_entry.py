"""The driver's contract without the corpus operators: the rest still imports and lists its queries."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


def listed(place):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(place), "PYTHONDONTWRITEBYTECODE": "1"}
    extra = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env["PYTHONPATH"] = os.pathsep.join([str(place), *extra])
    done = subprocess.run([sys.executable, "-c", CODE], cwd=place, env=env, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr
    return done.stdout.split()


def test_entry_without_corpus_operators(tmp_path):
    place = tmp_path / "repo"
    shutil.copytree(ROOT, place, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    n, pipeline, corpus = listed(place)
    assert int(n) > 100 and (pipeline, corpus) == ("False", "False")
    # folders that keep nothing but compiled files count as deleted too
    (place / "tidemill" / "llm" / "__pycache__").mkdir(parents=True)
    assert listed(place) == [n, "False", "False"]
