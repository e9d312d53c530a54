"""The registered queries against their SQL, on the smallest data."""

import pytest
from compare import compare, connection

from attestry.llm.queries import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, name):
    ok, message = compare(spark, connection(SF_DIR), name, QUERIES[name], CHECKS[name], SF_DIR)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_rows(spark, name):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = QUERIES[name](spark, SF_DIR)
    # op12 gives a row per piece of a document
    assert (found.count() == table.count() or name == "op12_packing") and found.select("doc_id").distinct().count() == table.count()
