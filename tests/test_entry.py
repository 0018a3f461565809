"""The entry module with and without the training-data operators."""

import importlib
import sys

import pytest

import __spark_entry__


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"bucket_ms", "service", "error_rate"}


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 100


def test_without_the_operators(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("sparkobs.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sparkobs.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    alone = importlib.reload(__spark_entry__)
    assert alone.llm is None and not any(k.startswith("op") and k[2].isdigit() for k in alone.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_other_import_errors_are_not_hidden(monkeypatch):
    class Broken:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Broken(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
