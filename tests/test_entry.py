"""The entry module with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    return done.returncode, [set(line.split()) for line in done.stdout.splitlines()], done.stderr


def test_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "slackline", tmp_path / "slackline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code, (queries, oracles), _ = names(tmp_path)
    assert code == 0 and oracles <= queries and len(queries) > 220 and not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_a_broken_subpackage_is_an_error(tmp_path):
    shutil.copytree(ROOT / "slackline", tmp_path / "slackline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_package\n")
    code, _, said = names(tmp_path)
    assert code and "no_such_package" in said
