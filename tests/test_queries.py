import pytest

from quire import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(name, same_rows):
    assert same_rows(plans.QUERIES[name], plans.SQL[name]) >= 0


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_entry_works_without_llm(monkeypatch, spark):
    """The engine's own queries don't need the llm subpackage or the pipeline."""
    import importlib.util

    import __spark_entry__ as entry

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("quire.llm", "corpus_pipeline")) else found(name, *a))
    assert set(entry.queries()) == set(plans.QUERIES)
    assert entry.entry(spark).count() == 10
