"""The entry module works before any session exists, and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') for k in q))"


def run(at):
    return subprocess.run([sys.executable, "-c", SAY], cwd=at, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": at})


def test_import_without_a_session():
    got = run(ROOT)
    assert got.returncode == 0, got.stderr


def test_import_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/datavane", tmp_path / "datavane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    got = run(str(tmp_path))
    assert got.returncode == 0 and got.stdout.split()[1] == "False", got.stderr


def test_import_without_the_package_of_the_vocabularies(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('away')")
    got = subprocess.run([sys.executable, "-c", SAY], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"})
    assert got.returncode == 0 and int(got.stdout.split()[0]) > 200, got.stderr
