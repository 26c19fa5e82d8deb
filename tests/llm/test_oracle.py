"""The operators that SQL can express, against their SQL."""

from __future__ import annotations

import pytest

from plaintide.llm.queries import ORACLES, QUERIES
from tests import oracle

from .conftest import TABLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, TABLES), oracle.connect(TABLES), ORACLES[name]) == []
