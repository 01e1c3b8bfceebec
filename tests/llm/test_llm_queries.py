"""Every query of the subpackage: beside its SQL where there is one, else run, on the smallest tables."""

import os

import pytest
from compare import same

from loomtrace.llm import queries

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
QUERIES = {n: q for m in queries.modules() for n, q in m.QUERIES.items()}
ORACLE = {n: q for m in queries.modules() for n, q in m.ORACLE.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        assert same(df, ORACLE[name], DATA) == ""
    else:
        df.write.format("noop").mode("overwrite").save()


def test_every_document(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert QUERIES["p9_kinds"](spark, DATA).count() == n == QUERIES["p9_stats"](spark, DATA).count()
    packed = QUERIES["p7_packed"](spark, DATA)
    assert [r["n"] for r in packed.groupBy("pack").agg({"doc_id": "count"}).selectExpr("1 n").collect()] == [1, 1, 1]
    assert packed.select("pack", "doc_id").distinct().count() == 3 * n
