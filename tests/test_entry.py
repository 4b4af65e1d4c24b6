"""The rest of the library stands without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/seqcohort", tmp_path / "seqcohort", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_corpus_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/seqcohort"):
        if "llm" in folder.split(os.sep):
            continue
        for name in files:
            if name.endswith(".py"):
                assert "seqcohort.llm" not in open(os.path.join(folder, name)).read()
