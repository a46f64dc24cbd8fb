"""The entry module without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = """
import __spark_entry__ as e
names = set(e.queries())
assert "exact_hash_clones" in names and set(e.oracle_sql()) <= names, names
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
"""


def copied(to: Path) -> Path:
    return Path(shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")))


def test_without_the_llm_folders(tmp_path):
    repo = copied(tmp_path / "repo")
    for name in ("twinseek/llm", "tests/llm"):
        shutil.rmtree(repo / name, ignore_errors=True)
    subprocess.run([sys.executable, "-c", ASK], cwd=repo, check=True)
    (repo / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", ASK], cwd=repo, check=True)


def test_where_the_subpackage_cannot_be_imported(tmp_path):
    repo = copied(tmp_path / "repo")
    (repo / "twinseek" / "llm").mkdir(exist_ok=True)
    (repo / "twinseek" / "llm" / "__init__.py").write_text("import no_such_module\n")
    subprocess.run([sys.executable, "-c", ASK], cwd=repo, check=True)
