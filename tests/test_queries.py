"""Every core query beside its SQL on the smallest tables; those without SQL are run."""

import os

import pytest
from compare import same

from loomtrace.plans import registry

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
QUERIES = {n: q for m in registry.modules() for n, q in m.QUERIES.items()}
ORACLE = {n: q for m in registry.modules() for n, q in m.ORACLE.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        assert same(df, ORACLE[name], DATA) == ""
    else:
        df.write.format("noop").mode("overwrite").save()


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
