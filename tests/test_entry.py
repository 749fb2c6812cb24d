"""The driver's contract, with and without the corpus operators."""

import importlib
import sys

import pytest


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


def test_without_the_corpus_operators(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("valuefit.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith("valuefit.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    import valuefit

    monkeypatch.delattr(valuefit, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    names = set(e.queries())
    assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names and "gae_returns" in names
    assert set(e.oracle_sql()) <= names
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_flagship(spark):
    import __spark_entry__ as e

    try:
        out = e.entry(spark)
    except Exception as x:  # the tables are not there
        if "PATH_NOT_FOUND" in str(x):
            pytest.skip("no tables")
        raise
    assert {r["split"] for r in out.collect()} == {"train", "val", "test"}
