import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent / "graphloom"


def test_nothing_imports_the_corpus_operators():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "corpus", None)
    names = entry.queries()
    assert "extract_nodes" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= set(names)
