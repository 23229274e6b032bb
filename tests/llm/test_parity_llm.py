"""Queries of this folder with SQL give the same rows in Spark and DuckDB."""

import pytest

from glyphtrail.llm.queries import ORACLES, QUERIES

from ..conftest import SF
from ..parity import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])
