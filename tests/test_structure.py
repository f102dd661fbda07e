"""What imports what."""

import ast
from pathlib import Path

ROOT = Path(__file__).parents[1]


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""


def test_nothing_else_imports_the_pipeline_operators():
    for path in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "lodestone").parts:
            assert not [m for m in imports(path) if m.startswith("lodestone.llm") or m == "corpus_pipeline"], path


def test_functions_know_no_operators():
    for path in (ROOT / "lodestone/functions").glob("*.py"):
        assert not [m for m in imports(path) if m.startswith("lodestone.") and not m.startswith("lodestone.functions")], path


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
