"""Every registered query of the folder that has SQL, against it, on the given tables."""

import pytest
from compare import connect, differences
from conftest import MEDIUM

from twinframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, name):
    assert not differences(spark, connect(MEDIUM), QUERIES[name], ORACLES[name], MEDIUM)
