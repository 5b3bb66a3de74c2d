"""The entry module with and without the optional subpackage."""
import importlib
import importlib.util
import sys

import pytest

import __spark_entry__ as E


def test_absent_subpackage_leaves_the_rest(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("dealflow.llm", "corpus_pipeline") else find(name, *a))
    try:
        module = importlib.reload(E)
        assert "dim_funnel_market" in module.queries() and not any(k.startswith("op") and k[2].isdigit() for k in module.queries())
        assert set(module.oracle_sql()) == set(module.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(E)


def test_a_broken_subpackage_is_an_error(monkeypatch):
    if not E._there("dealflow.llm"):
        pytest.skip("the subpackage is not there")
    import dealflow.llm
    monkeypatch.delattr(dealflow.llm, "queries")
    monkeypatch.setitem(sys.modules, "dealflow.llm.queries", None)
    try:
        with pytest.raises(ImportError):
            importlib.reload(E)
    finally:
        monkeypatch.undo()
        importlib.reload(E)
