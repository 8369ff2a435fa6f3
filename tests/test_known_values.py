"""
independently of this code."""

import os

import pytest

import __spark_entry__ as se

SF01 = "/root/testdata/sf0.01"
SF001 = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF01), reason="generated test data not present")
def test_sf001_totals(spark):
    k = se.queries()["kpi"](spark, SF01).first()
    assert (k.total_skus, k.total_stock, k.total_fba, k.total_fbf, k.total_sjit) == (2000, 1139407, 53764, 97518, 43310)
    assert se.queries()["channel_stock"](spark, SF01).count() == 3000
    assert se.queries()["orphan_stock"](spark, SF01).count() == 1100
    assert se.queries()["duplicates"](spark, SF01).count() == 100


@pytest.mark.skipif(not os.path.isdir(SF001), reason="generated test data not present")
def test_sf0001_duplicates(spark):
    assert se.queries()["duplicates"](spark, SF001).count() == 10
