import pytest

from compare import same, views
from helixlake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), views(SF), registry.ORACLE_SQL[name])
