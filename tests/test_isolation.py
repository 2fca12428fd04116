"""The training-data subpackage can be taken away."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("lakeloom/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"lakeloom\.llm|from \.+llm|corpus_pipeline", path.read_text()), path


def test_entry_registers_queries_with_and_without_it():
    import __spark_entry__ as entry

    assert len(entry.queries()) >= 200 and set(entry.oracle_sql()) <= set(entry.queries())
