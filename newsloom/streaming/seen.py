"""What was seen before, as keyed state of a stream: the first row of each key passes, later ones do not, until the first is too old.

The state of a key is one instant, so it grows with the keys of the last `days`, not with the rows; it lies in RocksDB, partitioned by key, and is
restored from the checkpoint. A call to Python costs far more than a row, so the state is grouped by a fixed number of buckets of keys and each bucket maps its
keys to instants: a micro-batch makes at most BUCKETS calls, its rows are reduced by frames, and a key asks the state once. An entry counts until `days` after the instant of the row that made it; one that no row has asked for is dropped by its
time to live, which counts from when it was written, so never earlier for rows that come in time. A key is a title fingerprint: the id of an item is made of
its address and title, so items of one id have one fingerprint, and an entry answers for both.

Keys that are not texts are told apart by their JSON. Rows without key or instant: null is a key like any other; a row without instant passes if its key is new and then stands as long as its time to live. Within a
micro-batch the first row in `order` (ascending, nulls first) counts. Repeated rows: one passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value, part of what a checkpoint holds: keys are handed to Python by buckets, not one by one.
BUCKETS = 4096


class _First(StatefulProcessor):
    """Passes at most one row a key and micro-batch; what it is called for is a bucket of keys."""

    def __init__(self, names: list[str], at: str, order: list[str], days: int):
        self.names, self.at, self.order, self.days = names, at, order, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "at timestamp", int(timedelta(days=self.days).total_seconds() * 1000))

    def _new(self, key: str | None, at: pd.Timestamp) -> bool:
        """Does no entry stand for the key? Then one is made."""
        found = self.seen.getValue((key,))
        if found is not None:
            (before,) = found
            if before is None or pd.isna(at) or at.tz_localize(None) - pd.Timestamp(before).tz_localize(None) <= timedelta(days=self.days):
                return False
        self.seen.updateValue((key,), (None if pd.isna(at) else at.to_pydatetime(),))
        return True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of a bucket come in several frames: never more than one frame and one row a key are held
        best = None
        for frame in rows:
            frame = frame.set_axis(self.names, axis=1)  # columns made on the way come without their names
            frame = frame if best is None else pd.concat([best, frame], ignore_index=True)
            best = frame.sort_values(self.order, na_position="first", kind="stable").drop_duplicates("_key")
        if best is None:
            return
        fresh = [self._new(None if pd.isna(k) else k, at) for k, at in zip(best["_key"], best[self.at])]
        if any(fresh):
            yield best[fresh].drop(columns=["_bucket", "_key", *self.order])

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, key: str, at: str, order: list, days: int = 365) -> DataFrame:
    """The rows of a stream whose key no row of the last `days` had; of one micro-batch the first in `order`."""
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # state with a time to live asks for batches without data for ever, so a run over what is available now would not end
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    places = {f"_order{i}": c for i, c in enumerate(order)}
    name = F.col(key) if stream.schema[key].dataType == T.StringType() else F.to_json(F.struct(F.col(key)))
    rows = stream.withColumns({"_key": name, "_bucket": F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")} | places)
    return rows.groupBy("_bucket").transformWithStateInPandas(_First(rows.columns, at, list(places), days), stream.schema, "Append", "ProcessingTime")
