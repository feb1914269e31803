"""Recency, ranking, quotas and limits."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ZONE, local_day
from ..schema import ORDINALS


def rank_order() -> list[Column]:
    """Score and date descending, then the order in which the sources gave the items, as ascending columns."""
    return [(-F.col("classification.score")).alias("score"), (-F.unix_micros("published_at")).alias("published"), *[F.col(c) for c in ORDINALS]]


def recent(items: DataFrame, run_at: datetime, hours: int = 96, complete: bool = True) -> DataFrame:
    """Items of the window, its start included; with a title and an address unless `complete` is false."""
    out = items.filter(F.col("published_at") >= F.lit(run_at - timedelta(hours=hours)))
    return out.filter("title <> '' and url <> ''") if complete else out


def sent_on_day(history: DataFrame, run_at: datetime, zone: str = ZONE) -> int:
    """Messages sent on the local day of the run."""
    return history.filter(local_day(F.col("sent_at"), zone) == local_day(F.lit(run_at), zone)).count()


def allowed(per_run: int, per_day: int, sent: int) -> int:
    return min(per_run, max(0, per_day - sent))


def daily_quota(rows: DataFrame, at: str, order: list, per_day: int, zone: str = ZONE) -> DataFrame:
    """The first `per_day` rows of each local day. Ranks are cut within each task before the shuffle (window group limit)."""
    own = Window.partitionBy("local_day").orderBy(*order)
    return rows.withColumn("local_day", local_day(F.col(at), zone)).withColumn("place", F.row_number().over(own)).filter(F.col("place") <= per_day)
