"""History of sent items: a table behind a commit log, pruned by age, extended by key; and the outbox of messages."""

from __future__ import annotations

import re
import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SEEN
from .log import CommitLog


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def history_log(spark: SparkSession, folder: str, run_at: datetime | None = None, days: int = 365) -> CommitLog:
    """The log of a history; its parts become one without what is older than `days` at `run_at`."""
    return CommitLog(spark, f"{folder}/history", SEEN, "id", (lambda records: pruned(records, run_at, days)) if run_at else lambda records: records)


def load_history(spark: SparkSession, folder: str) -> DataFrame:
    """The current version; an empty history if there is none yet."""
    return history_log(spark, folder).load()


def save_history(history: DataFrame, folder: str, expected: int | None = None) -> int:
    """A whole new version in place of version `expected` (default: the current one); its number. Raises Conflict where another run was first."""
    return history_log(history.sparkSession, folder).commit(history, expected, whole=True)


def add_to_history(records: DataFrame, folder: str, run_at: datetime | None = None, days: int = 365, note: dict | None = None) -> int:
    """A new version with records that replace those of the same id; what another run commits meanwhile stays."""
    return history_log(records.sparkSession, folder, run_at, days).change(lambda _: latest(records), note=note)


def pruned(history: DataFrame, run_at: datetime, days: int = 365) -> DataFrame:
    """Without records older than `days`; records without a readable date stay."""
    return history.filter(~F.coalesce(F.col("sent_at") < F.lit(run_at - timedelta(days=days)), F.lit(False)))


def seen_records(items: DataFrame, sent_at: datetime) -> DataFrame:
    """History records of sent items (with keys)."""
    from ..functions.urls import canonical

    category = F.coalesce(F.col("category") if "category" in items.columns else F.col("classification.category"), F.lit("GERAL"))
    return items.select("id", F.lit(sent_at).cast("timestamp").alias("sent_at"), canonical(F.col("url")).alias("url"), "title", "title_fingerprint", "content_tokens", category.alias("category"))


def latest(records: DataFrame) -> DataFrame:
    """Of records with one id the latest."""
    own = Window.partitionBy("id").orderBy(F.desc("sent_at"), F.xxhash64("title", "url"))
    return records.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def upserted(history: DataFrame, new: DataFrame) -> DataFrame:
    """New records replace those of the same id; of new records with one id the latest stays."""
    new = latest(new)
    return history.join(new.select("id"), "id", "left_anti").select(new.columns).unionByName(new)


#: Fixed value: the form of a group's id.
GROUP_ID = r"\d+(?:-\d+)?@g\.us"


def require_destination(group: str) -> str:
    """The id of the group that gets the messages; raises if it is none."""
    if not re.fullmatch(GROUP_ID, group or ""):
        raise ValueError("not the id of a group")
    return group


def outbox(spark: SparkSession, folder: str) -> DataFrame | None:
    """Records of what was sent since the history was last extended."""
    path, fs = _path(spark, f"{folder}/outbox")
    return spark.read.schema(SEEN).parquet(f"{folder}/outbox") if fs.exists(path) else None


def settle(spark: SparkSession, folder: str, run_at: datetime | None = None, days: int = 365, note: dict | None = None) -> None:
    """Put what the outbox holds into the history, then empty it; a crash between the two only repeats the first."""
    sent = outbox(spark, folder)
    if sent is not None:
        add_to_history(sent, folder, run_at, days, note)
        clear_outbox(spark, folder)


def with_outbox(history: DataFrame, folder: str) -> DataFrame:
    """The history with what the outbox says was sent since it was saved."""
    sent = outbox(history.sparkSession, folder)
    return history if sent is None else upserted(history, sent)


def clear_outbox(spark: SparkSession, folder: str) -> None:
    """To be called once a history that holds the outbox is saved."""
    path, fs = _path(spark, f"{folder}/outbox")
    fs.delete(path, True)


def delivered(messages: DataFrame, order: str, send, folder: str, sent_at: datetime, history: DataFrame, delay: float = 0.0, sleep=time.sleep) -> DataFrame:
    """Send the few messages of a run in order, `delay` seconds apart; after each, its record is appended to the outbox, so an error or a
    crash ends the rest and what was sent stays known.

    Returns the history with what was sent now. messages: the run's quota bounds them; id, text and the record's columns.
    """
    spark, sent = messages.sparkSession, []
    for n, row in enumerate(messages.orderBy(order).toLocalIterator()):
        if n and delay > 0:
            sleep(delay)
        send(row["text"])
        one = spark.createDataFrame([row], messages.schema)
        seen_records(one, sent_at).write.mode("append").parquet(f"{folder}/outbox")
        sent.append(row)
    # not read from the outbox: two scans of one folder count as the same to the planner, also where files came between them
    return upserted(history, seen_records(spark.createDataFrame(sent, messages.schema), sent_at)) if sent else history
