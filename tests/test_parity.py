"""Every query with SQL gives the same rows in Spark and DuckDB; the others run."""

import pytest

from glyphtrail.plans import REGISTRY

from .conftest import SF
from .parity import same_rows


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    run, sql = REGISTRY[name]
    df = run(spark, SF)
    if sql:
        same_rows(df, duck, sql)
    else:
        assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
