"""The driver's entry, with and without the corpus operators."""

import importlib.util
import sys

import __spark_entry__ as entry
from slipway.plans.catalog import QUERIES, SQL


def test_queries_without_the_corpus_folders(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("slipway.llm") else find(name, *a))
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("slipway.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Hidden:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name.startswith("slipway.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Hidden, *sys.meta_path])
    assert entry.queries().keys() == QUERIES.keys() and entry.oracle_sql().keys() == SQL.keys()


def test_queries_of_the_library_are_always_there():
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()
