"""The keyed stream of bar versions holds one state a security, however many days it has."""

import datetime as dt

from vintage.streaming import ingest


def test_days_of_a_security_share_a_state(spark, tmp_path):
    rows = [(s, dt.datetime(2024, 1, 1 + d, 12), 100 * d + k, float(d + k), 1, dt.datetime(2024, 1, 1 + d, 13) + dt.timedelta(days=7 * k)) for s in ("a", "b") for d in range(20) for k in range(2)]
    ticks = spark.createDataFrame(rows, "security_id string, ts timestamp, tick_id long, price double, size int, available_at timestamp")
    ticks.coalesce(1).write.parquet(f"{tmp_path}/ticks")
    told = ingest.bar_versions(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks"))
    query = told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) == 2
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    # each day is told by its timer or by the tick that came a week later, which makes its second version
    assert {(r.security_id, r.effective_date, r.version, r.volume) for r in got} == {(s, dt.date(2024, 1, 1 + d), v, v) for s in ("a", "b") for d in range(20) for v in (1, 2)}
