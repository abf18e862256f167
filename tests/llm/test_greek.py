"""Benchmark passages whose lower-casing depends on what stands beside a word."""

import pytest
from pyspark.sql import functions as F

from strandlog.llm import decontaminate


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_final_sigma_before_an_apostrophe(spark, make, limit):
    item = " ".join(["\u039f\u0394\u039f\u03a3'\u0391\u0392"] * 7)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.find(make([item]), items, max_broadcast=limit).select(F.col("n_hit")).first()
    assert found.n_hit == 14
