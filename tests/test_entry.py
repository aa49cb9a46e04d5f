import importlib

from pyspark.sql import DataFrame


def test_registry():
    e = importlib.import_module("__spark_entry__")
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "segment_stats" in q and "p1_found" in q and "p2_found" in q


def test_core_does_not_need_the_optional_part():
    import newsloom.operators.nested  # noqa: F401
    import newsloom.plans.reports as r

    assert all("llm" not in f.__module__ for f in r.QUERIES.values())


def test_entry_runs(spark):
    e = importlib.import_module("__spark_entry__")
    df = e.entry(spark)
    assert isinstance(df, DataFrame) and df.limit(1).count() == 1
