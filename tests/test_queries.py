import pytest
from helpers import SF, oracle, rows_of

import __spark_entry__
from millrace.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = rows_of(catalogue.QUERIES[name](spark, SF).toPandas())
    assert got == rows_of(oracle(catalogue.ORACLE_SQL[name]))
    assert got[1] or name in ("sampling_pipeline", "index_perm_resume")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
