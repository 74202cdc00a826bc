import pytest
from oracle import compare
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, small, name):
    compare(spark, small, catalogue.QUERIES[name], catalogue.SQL[name])


def test_queries_without_sql_give_rows(spark, small):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry_imports_without_the_llm_folder(monkeypatch):
    import builtins
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("tidemark.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) == set(catalogue.SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
