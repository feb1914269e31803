from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators.select import daily_quota
from newsloom.streaming.quota import best_of_days, days_of

SCHEMA = "n int, at timestamp, v int"


def test_a_stream_keeps_the_best_of_each_day_of_a_zone_that_changes_its_clock(spark, tmp_path):
    # the last Sunday of March and of October 2025: days of 23 and of 25 hours
    hours = [datetime(2025, 3, 29, 20) + timedelta(hours=h) for h in range(60)] + [datetime(2025, 10, 25, 20) + timedelta(hours=h) for h in range(60)]
    rows = [(i, at, (i * 7919) % 101) for i, at in enumerate(hours)] + [(900 + i, None, i) for i in range(4)]
    frame, order = spark.createDataFrame(rows, SCHEMA), [F.desc("v"), "n"]
    want = sorted(str(tuple(r)) for r in daily_quota(frame, "at", order, 3, "Europe/Berlin").select("n", "local_day", "place").collect())
    for k in range(2):
        frame.filter(F.col("n") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        best_of_days(stream, f"file://{tmp_path}/days", f"{tmp_path}/check", "at", order, 3, "Europe/Berlin").awaitTermination()
    log = days_of(spark, f"file://{tmp_path}/days", frame.schema)
    got = lambda: sorted(str(tuple(r)) for r in log.load().select("n", "local_day", "place").collect())
    assert got() == [x for x in want if "None" not in x]
    # without its commit a batch is repeated: nothing changes
    import os

    before, number = got(), log.current()[0]
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{tmp_path}/check/commits/{name}"):
            os.remove(f"{tmp_path}/check/commits/{name}")
    best_of_days(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/days", f"{tmp_path}/check", "at", order, 3, "Europe/Berlin").awaitTermination()
    assert got() == before and log.current()[0] == number
