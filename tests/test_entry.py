"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

from conftest import ROOT


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_runs_flagship(spark):
    module = load_entry()
    df = module.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[:3] == ["segment", "airport_name", "trip_count"]


def test_queries_and_oracle_keys_match():
    module = load_entry()
    queries, oracle = module.queries(), module.oracle_sql()
    from cabflow.plans.queries import QUERIES

    assert len(QUERIES) == 26 and set(QUERIES) <= set(oracle) <= set(queries)
    assert all(callable(fn) for fn in queries.values())
