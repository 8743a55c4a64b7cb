"""Every registered query of the audit operators against its SQL on DuckDB, on the smallest table set."""

import pytest
from oracle import connect, difference

from auditloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("gone", ["corpus_pipeline", "auditloom.llm"])
def test_entry_imports_without_llm(monkeypatch, gone):
    """Either may be gone: the pipeline at the top, which is imported first, or the subpackage behind a pipeline that is there."""
    import importlib
    import importlib.abc
    import sys

    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name == gone:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m.startswith("auditloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delattr("auditloom.llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert entry.llm is None and "h07_bridge_edges" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")] and "pipeline" not in entry.queries()
    for m in [m for m in sys.modules if m.startswith("auditloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        sys.modules.pop(m)


def test_entry_raises_if_the_subpackage_lacks_something(monkeypatch):
    """A missing wheel of the training-data operators is said, not swallowed."""
    import importlib
    import importlib.abc
    import sys

    pytest.importorskip("auditloom.llm")

    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name == "tiktoken":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m.startswith("auditloom.llm") or m in ("corpus_pipeline", "__spark_entry__") or m.split(".")[0] == "tiktoken"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError, match="tiktoken"):
        importlib.import_module("__spark_entry__")
