import os
import re

import pytest

import __spark_entry__ as entry
from veriflate import queries_decode

SMALL = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert "d03_member_roundtrip" in queries


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["source", "member_index", "decoded_length", "md5"] and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["k11_drain", "d12_bad_codes", "k03_levels", "k20_fixture_shapes", "d13_own_inflate"])
def test_one_worker_a_task(spark, name):
    """Each Python step of a plan is one more worker in every task; k03_levels had eight."""
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|ArrowEvalPython|BatchEvalPython", plan)) == 1


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_streams_are_sent_on_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(queries_decode, "_SENT", 5000)
    docs = spark.createDataFrame([("s", i, bytes([i]) * 900) for i in range(50)], "source string, doc_id long, body binary").coalesce(1)
    rows = queries_decode._streams(docs, lambda body: body * 2)
    assert sorted((r.doc_id, bytes(r.stream)) for r in rows.collect()) == [(i, bytes([i]) * 1800) for i in range(50)]
