import os

import pytest

import __spark_entry__ as e


def test_registry():
    names, texts = e.queries(), e.oracle_sql()
    assert set(texts) <= set(names) and len(texts) > 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["doc_id", "item_id"] and df.count() > 0
