"""The entry module imports where Spark's ML jars, the llm folders or other optional parts are absent."""

import glob
import importlib.util
import pathlib
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def _load():
    for name in [m for m in sys.modules if m.split(".")[0] in ("sourcelens", "__spark_entry__")]:
        sys.modules.pop(name)
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    return entry


def test_entry_needs_no_file_of_the_installation(monkeypatch):
    kept = {m: v for m, v in sys.modules.items() if m.split(".")[0] == "sourcelens"}
    monkeypatch.setattr(glob, "glob", lambda *a, **k: [])
    try:
        entry = _load()
        assert len(entry.queries()) >= 57
        assert set(entry.oracle_sql()) <= set(entry.queries())
    finally:
        for name in [m for m in sys.modules if m.split(".")[0] == "sourcelens"]:
            sys.modules.pop(name)
        sys.modules.update(kept)
