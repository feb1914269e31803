"""The daily quota over a stream: the best rows of each local day so far, kept behind a commit log.

A micro-batch meets only the kept rows of the days that it touches, at most `per_day` a day, and its best rows of a day replace what the log held of that day. Ranks are
cut in each task before the shuffle, so a day that has a third of all rows is not in one task. Days are those of the zone, whatever its clock does. The
commit that holds a batch names it, so a batch that is repeated after a crash changes nothing, and two streams may write to one log.

Rows without an instant are of no day and are left out. With an `order` that ranks all rows apart, reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import ZONE
from ..operators.select import daily_quota
from ..sources.log import CommitLog

DAY, PLACE = T.StructField("local_day", T.DateType()), T.StructField("place", T.IntegerType())


def days_of(spark: SparkSession, folder: str, schema: T.StructType) -> CommitLog:
    """The log of the best rows (columns `schema`, local_day, place)."""
    return CommitLog(spark, folder, T.StructType([*schema.fields, DAY, PLACE]), "local_day")


def best_of_days(stream: DataFrame, folder: str, checkpoint: str, at: str, order: list, per_day: int, zone: str = ZONE, trigger: dict | None = None) -> StreamingQuery:
    """Keep the first `per_day` rows of each local day in `order`."""
    columns, schema = stream.columns, stream.schema

    def each(batch: DataFrame, number: int) -> None:
        log = days_of(batch.sparkSession, folder, schema)
        if number <= log.current()[1].get("note", {}).get(checkpoint, -1):
            return
        fresh = daily_quota(batch.filter(F.col(at).isNotNull()), at, order, per_day, zone)
        days = fresh.select("local_day").distinct()

        def merged(now: DataFrame) -> DataFrame:
            held = now.join(days, "local_day", "left_semi")
            return daily_quota(held.select(columns).unionByName(fresh.select(columns)), at, order, per_day, zone)

        log.change(merged, note={checkpoint: number})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
