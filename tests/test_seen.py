from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedupe
from newsloom.schema import SEEN
from newsloom.sources import state
from newsloom.streaming import seen
from newsloom.streaming.seen import first_of_key

AT = datetime(2026, 8, 1)
KIND = "n int, url string, title string, summary string, published_at timestamp"


def item(n, url, title, days=0):
    return n, f"https://a.br/{url}", title, "s", AT + timedelta(days=days)


BATCHES = [
    [item(3, "1", "Cidade sai"), item(1, "2", "Cidade sai"), item(2, "3", "Outra notícia")],
    [item(4, "1", "CIDADE sai"), item(5, "9", "Cidade de sai"), item(6, "3", "Notícia nova"), item(7, "3", "Notícia nova")],
    [item(8, "3", "Notícia nova"), item(9, "4", "Mais uma")],
]


def keyed(frame):
    return dedupe.with_keys(frame)


def passed(spark, tmp_path, batches, days=365):
    """The numbers that pass each batch; the stream is started anew for each, from its checkpoint."""
    out = []
    for i, batch in enumerate(batches):
        keyed(spark.createDataFrame(batch, KIND)).write.mode("append").parquet(f"{tmp_path}/in")
        schema = keyed(spark.createDataFrame([], KIND)).schema
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        first_of_key(stream, "title_fingerprint", "published_at", [F.col("n")], days).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(r["n"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()))
    return [sorted(set(b) - set(a)) for a, b in zip([[], *out], out)]


def test_equals_the_history_over_batches_and_restarts(spark, tmp_path):
    history, want = spark.createDataFrame([], SEEN), []
    for batch in BATCHES:
        fresh = dedupe.unsent(keyed(spark.createDataFrame(batch, KIND)), history)
        rows = sorted(fresh.collect(), key=lambda r: r["n"])
        first = {}
        for r in rows:
            first.setdefault(r["title_fingerprint"], r)
        want.append(sorted(r["n"] for r in first.values()))
        kept = fresh.filter(F.col("n").isin(want[-1])).withColumn("category", F.lit("X"))
        history = spark.createDataFrame(state.upserted(history, state.seen_records(kept, AT)).collect(), SEEN)
    assert want == [[1, 2], [5, 6], [9]]
    assert passed(spark, tmp_path, BATCHES) == want


def test_an_entry_ends(spark, tmp_path):
    batches = [[item(1, "1", "T")], [item(2, "1", "T", 10)], [item(3, "1", "T", 11), item(4, "2", "T", 22)]]
    assert passed(spark, tmp_path, batches, days=10) == [[1], [], [3]]


@pytest.mark.parametrize("days", [5])
def test_odd_rows(spark, tmp_path, days):
    none = (1, None, None, None, None)
    assert passed(spark, tmp_path, [[none, none], [(2, None, "", None, AT)], [(3, "u", "t", "", None), (4, "u", "t", "", AT)]], days) == [[1], [], [3]]


class Held(dict):
    """A handle whose map state is this dictionary."""

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


def test_one_call_decides_many_keys_over_several_frames():
    names = ["n", "at", "_key", "_bucket", "_order0"]
    frame = lambda *rows: pd.DataFrame([(n, pd.Timestamp(AT) + timedelta(days=d), k, 0, n) for n, k, d in rows], columns=names)
    state, first = Held(), seen._First(names, "at", ["_order0"], 10)
    first.init(state)
    call = lambda *frames: sorted(n for out in first.handleInputRows((0,), iter(frames), None) for n in out["n"])
    assert call(frame((5, "a", 0), (3, "b", 0), (4, None, 0)), frame((2, "a", 0), (6, "b", 0), (7, "c", 0))) == [2, 3, 4, 7]
    assert call(frame((8, "a", 10), (9, "b", 11), (10, None, 1), (11, "d", 0))) == [9, 11] and len(state) == 5
    assert call(frame((12, "a", 5))) == []


def test_keys_of_one_bucket_and_keys_that_are_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "BUCKETS", 1)
    kind = "n int, key double, at timestamp"
    spark.createDataFrame([(i, None if i % 5 == 4 else float(i % 5), AT) for i in range(20)], kind).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    first_of_key(stream, "key", "at", [-F.col("n")]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.read.schema(kind).parquet(f"{tmp_path}/out").collect()) == [15, 16, 17, 18, 19]
