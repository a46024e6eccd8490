import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tests.oracle import duck, spark_rows

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_oracle(spark, name):
    got, want = spark_rows(entry.queries()[name](spark, f"{DATA}/sf0.001")), duck(SQL[name], "sf0.001")
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and len(want[1]) > 0
    assert got[1] == want[1], [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
