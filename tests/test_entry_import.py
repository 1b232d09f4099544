"""The driver's entry without the optional parts, and with a fault in them."""

import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); print('agg_fpm' in q, 'op7_mix' in q, 'pipeline' in q, len(e.oracle_sql()) > 90)"


def answer(at):
    return subprocess.run([sys.executable, "-c", ASK], cwd=at, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})


def test_entry_without_the_optional_parts(tmp_path):
    at = tmp_path / "repo"
    copytree(ROOT, at, ignore=ignore_patterns(".git", "__pycache__", "tests", "llm", "corpus_pipeline.py"))
    assert answer(at).stdout.split() == ["True", "False", "False", "True"]
    # a part that is there, but broken, must not vanish silently
    (at / "tallyhelix" / "llm").mkdir()
    (at / "tallyhelix" / "llm" / "__init__.py").write_text("")
    (at / "tallyhelix" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    broken = answer(at)
    assert broken.returncode != 0 and "no_such_module_at_all" in broken.stderr
