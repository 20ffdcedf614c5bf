import importlib


def test_every_sql_has_a_query_and_names_are_unique(spark):
    e = importlib.import_module("__spark_entry__")
    found = e.queries()
    assert set(e.oracle_sql()) <= set(found) and len(found) > 40


def test_flagship(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() >= 1
