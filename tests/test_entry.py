"""The driver contract, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(sum(k.startswith('op') and k[2].isdigit() for k in e.queries()), 'pipeline' in e.queries(), len(e.queries()) > 80, set(e.oracle_sql()) <= set(e.queries()))"


def asked(folder) -> str:
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


def copied(tmp_path, *left_out: str):
    to = tmp_path / "copy"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in left_out:
        if (to / name).is_dir():
            shutil.rmtree(to / name)
        else:
            (to / name).unlink(missing_ok=True)
    return to


def test_without_the_subpackage(tmp_path):
    assert asked(copied(tmp_path, "parcelmill/llm", "tests/llm")) == "0 False True True"


def test_without_subpackage_and_pipeline(tmp_path):
    assert asked(copied(tmp_path, "parcelmill/llm", "tests/llm", "corpus_pipeline.py")) == "0 False True True"


def test_other_import_errors_are_raised(tmp_path):
    to = copied(tmp_path, "parcelmill/llm", "tests/llm")
    (to / "corpus_pipeline.py").write_text("import surely_not_installed\n")
    assert subprocess.run([sys.executable, "-B", "-c", ASK], cwd=to, capture_output=True).returncode
