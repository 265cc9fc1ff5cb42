"""Every registered query with SQL gives the rows of the SQL; the others run."""

import pytest
from conftest import same_rows

from seqframe import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, sf, name):
    same_rows(spark, sf, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
