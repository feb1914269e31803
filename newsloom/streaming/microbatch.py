"""The radar over a stream of items: each micro-batch runs the batch plan against the history, so results equal the batch runs.

A watermark bounds how late an item may be; exact repeats inside it are dropped by the engine's state, all older ones and
resembling ones by the history table. Delivery is at least once: only a message that was sent and not yet put down is sent again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import render
from ..operators.dedupe import with_keys
from ..operators.rules import CONSORTIA, RuleSet
from ..operators.select import rank_order
from ..plans.run import as_items, run
from ..sources.index import TokenIndex
from ..sources.state import add_to_history, delivered, history_log, load_history, seen_records, settle
from ..sources.tables import scratch


def without_repeats(stream: DataFrame, at: str, keys: list[str], hours: int = 96) -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, at: str, keys: list[str], hours: int = 96, zone_shift: str = "3 hours") -> DataFrame:
    """Rows by key and local day; day windows start `zone_shift` after midnight UTC."""
    return stream.withWatermark(at, f"{hours} hours").groupBy(F.window(at, "1 day", startTime=zone_shift), *keys).agg(F.count(F.lit(1)).alias("n"))


def add_to_sink(rows: DataFrame, sink: str, number: int) -> None:
    """Append rows (with an id) to the folder of a batch, but for those that an earlier try of the batch has put there."""
    spark, folder = rows.sparkSession, f"{sink}/batch={number}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.schema("id string").parquet(folder), "id", "left_anti")
    rows.write.mode("append").parquet(folder)


def start(stream: DataFrame, history_folder: str, checkpoint: str, config: dict, clock: Callable[[], datetime], rules: RuleSet = CONSORTIA, send: Callable[[str], None] | None = None, sink: str | None = None, trigger: dict | None = None, delay: float = 0.0, indexed: bool = False, parse: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run the radar on every micro-batch; `send` gets each message of a batch's selection in rank order, `delay` seconds apart.

    What was sent is known after each message (the outbox), so a batch that is repeated after a failure goes on where it stopped.
    A batch whose end the history knows (its commits name the last batch of each checkpoint) is not run again, and `sink` gets no item of a batch twice.
    indexed: keep an index of the history's token sets, for histories that are long beside a batch. parse: rows of a batch to items.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch():  # no table of a batch is read after it
            spark, now, days = batch.sparkSession, clock(), config["stateRetentionDays"]
            log = history_log(spark, history_folder)
            if number <= log.current()[1].get("note", {}).get(checkpoint, -1):
                return
            # what a batch that failed has sent
            settle(spark, history_folder, now, days)
            index = TokenIndex(spark, f"{history_folder}/index") if indexed else None
            if index:
                index.follow(log)
            result = run(as_items(parse(batch) if parse else batch), load_history(spark, history_folder), now, config, rules, index)
            keyed = result.selected if "id" in result.selected.columns else with_keys(result.selected)
            if sink:
                add_to_sink(keyed, sink, number)
            if send:
                placed = render.messages(keyed, "text").withColumn("_place", F.struct(*rank_order()))
                delivered(placed, "_place", send, history_folder, now, result.history, delay)
                settle(spark, history_folder, now, days, {checkpoint: number})
            elif keyed.head(1):
                add_to_history(seen_records(keyed, now), history_folder, now, days, {checkpoint: number})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
