"""The entry point with and without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
LISTED = "import __spark_entry__ as e; print(*sorted(e.queries()))"


def _listed(place: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", LISTED], cwd=place, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def _copy(tmp_path: Path, *left_out: str) -> Path:
    place = tmp_path / "copy"
    shutil.copytree(REPO, place, ignore=lambda folder, names: [
        n for n in names if n in {".git", "__pycache__", "tests"} or str(Path(folder, n).relative_to(REPO)) in left_out])
    return place


def test_entry_without_the_optional_part(tmp_path):
    rest = _listed(_copy(tmp_path, "capturelake/llm"))
    assert "run_stats_by_scope" in rest and len(rest) >= 151
    assert "pipeline" not in rest and not any(name.startswith("op") and name[2].isdigit() for name in rest)


def test_entry_without_the_optional_part_and_pipeline(tmp_path):
    assert len(_listed(_copy(tmp_path, "capturelake/llm", "corpus_pipeline.py"))) >= 151
