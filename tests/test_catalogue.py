"""Every registered query runs on the smallest tables and agrees with its SQL, if it has one."""

import oracle
import pytest
from meshwave.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE_SQL])
def test_agrees_with_sql(spark, small, con, name):
    assert not oracle.difference(catalogue.QUERIES[name](spark, small), con, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).collect()[0]["n"] == 720
    assert set(e.oracle_sql()) <= set(e.queries())


def test_likelihood_ratio_uses_every_cell(spark, small, monkeypatch):
    seen = []
    monkeypatch.setattr(catalogue.W, "likelihood_ratio", lambda field, grid, *a: seen.append((field, grid)))
    catalogue.QUERIES["likelihood_ratio_test"](spark, small)
    (field, grid), = seen
    assert grid.n_points == 720 and field.count() == catalogue.src.event_fields(spark, small).count()
