"""The entry without the corpus operators."""

import sys

import __spark_entry__
from weft import catalog


def test_entry_without_what_the_corpus_operators_need(monkeypatch):
    for name in [m for m in sys.modules if m == "public_tokenizers" or m.startswith("weft.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    import weft

    monkeypatch.delattr(weft, "llm", raising=False)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)
    assert len(catalog.QUERIES) > 350


def test_sql_belongs_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
