"""The driver contract holds with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


def _names(root: Path) -> set[str]:
    return set(subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, check=True).stdout.split())


def test_all_but_the_text_operators_live_without_their_folders(tmp_path):
    every = tmp_path / "repo"
    shutil.copytree(ROOT, every, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(every / "gridstat" / "llm", ignore_errors=True)
    shutil.rmtree(every / "tests" / "llm", ignore_errors=True)
    # The pipeline's file may go with them or stay: either way it is no query any more.
    left = _names(every)
    assert "growth_summary" in left and "pipeline" not in left and not any(n.startswith("op") and n[2].isdigit() for n in left)
    (every / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _names(every) == left <= _names(ROOT)
    # Nothing else imports them.
    assert not [p for p in (every / "gridstat").rglob("*.py") if "gridstat.llm" in p.read_text()]
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=every, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]
