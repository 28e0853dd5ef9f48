"""Every query of the library against its SQL, or for rows and finite values where there is none."""

import numpy as np
import pytest
from compare import assert_same

import __spark_entry__ as entry
from gridstat.plans import catalogue

NAMES = sorted(catalogue.queries())
#: Queries with measures that need larger grids than those of the tables.
OPEN = {"summary_features"}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    got = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert_same(got, duck.execute(sql).df())
    else:
        numbers = got.select_dtypes("number")
        assert len(got) and (np.isfinite(numbers) | numbers.isna()).all(axis=None) and (numbers.notna().any() | (name in OPEN)).all()


def test_names_match():
    assert set(catalogue.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["feature", "mean", "std", "cv"]
    assert out.count() == 5


def test_most_queries_have_sql():
    assert len(catalogue.oracle_sql()) >= 120
