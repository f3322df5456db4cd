"""The entry point with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_parts():
    code = "import sys; sys.modules['blockweave.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1:] == ["False", "False"]


def test_nothing_else_imports_the_optional_part():
    for p in [*REPO.glob("blockweave/**/*.py"), REPO / "bench.py"]:
        if "llm" not in p.parts:
            assert "blockweave.llm" not in p.read_text() and "from .llm" not in p.read_text()
