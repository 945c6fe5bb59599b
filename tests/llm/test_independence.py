"""The rest of the library must not need this subpackage."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_it():
    for path in (ROOT / "quarrymap").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_no_local_checkpoints():
    for path in [*(ROOT / "quarrymap").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
        assert "localCheckpoint" not in path.read_text()
