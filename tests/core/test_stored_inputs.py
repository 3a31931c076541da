"""Queries that store what they read twice."""

import uuid

from pyspark.sql import functions as F

from vintage.plans import service_queries

FOLDER = "/root/testdata/sf0.001"


def test_reparsed_bars_hash_bodies_once(spark, monkeypatch):
    """Hashes that another evaluation would not give again, as of lists in another order."""
    plain, made = service_queries.payloads, F.udf(lambda _: uuid.uuid4().hex).asNondeterministic()
    want = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    monkeypatch.setattr(service_queries, "payloads", lambda *a: plain(*a).withColumn("content_hash", made("subject")))
    assert service_queries.reparsed_bars(spark, FOLDER).count() == want > 0
