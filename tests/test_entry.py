"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def names(at: Path) -> list[str]:
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=at, capture_output=True, text=True, check=True).stdout.split()


def without(tmp_path: Path, *left_out: str) -> Path:
    skip = shutil.ignore_patterns("__pycache__", *left_out)
    shutil.copytree(REPO / "cladewise", tmp_path / "cladewise", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    return tmp_path


def core_only(found: list[str]) -> bool:
    return "l13_tree_loglik" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_imports_without_the_corpus_part(tmp_path):
    assert core_only(names(without(tmp_path / "a", "llm", "corpus_pipeline.py")))
    assert core_only(names(without(tmp_path / "b", "llm")))


def test_imports_without_what_the_corpus_part_needs(tmp_path):
    at = without(tmp_path / "c")
    (at / "xxhash.py").write_text("raise ImportError('not here')")
    assert core_only(names(at))


def test_flagship(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["loglik"] < 0
