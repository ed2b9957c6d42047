"""Queries without an oracle read every row."""

from pyspark.sql import functions as F

from quern.plans import adapters as ad
from quern.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_etags_are_made_of_all_chunks(spark):
    parts = catalogue.QUERIES["multi_etag"](spark, SF).agg(F.sum("parts")).first()[0]
    assert parts == ad.chunks(spark, SF).count() > 0
