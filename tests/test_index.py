import random
from datetime import datetime, timedelta, timezone

import pytest

from newsloom.operators import dedupe
from newsloom.schema import SEEN
from newsloom.sources import index as module
from newsloom.sources import state
from newsloom.sources.index import TokenIndex

NOW = datetime(2026, 8, 14, tzinfo=timezone.utc)
ITEMS = "n int, category string, content_tokens array<string>"


def sets(rng, n, start=0):
    words = [f"w{i}" for i in range(30)]
    return [(start + i, rng.choice(["A", "B", None, "GERAL"]), sorted(rng.sample(words[: rng.choice([8, 30])], rng.randrange(0, 8)))) for i in range(n)]


def records(spark, rows, at=NOW):
    return spark.createDataFrame([(str(n), at, "u", "t", f"f{n}", t, c) for n, c, t in rows], SEEN)


def left(items, index=None, history=None, days=365):
    rows = dedupe.unlike_history(items, history) if index is None else index.against(NOW, days)(items, None)
    return sorted(r["n"] for r in rows.collect())


def test_follows_the_history_and_equals_it(spark, tmp_path, monkeypatch):
    rng, folder = random.Random(3), f"file://{tmp_path}"
    log, index = state.history_log(spark, folder), TokenIndex(spark, f"{folder}/index")
    items = spark.createDataFrame(sets(rng, 150), ITEMS)
    index.follow(log)
    assert left(items, index) == sorted(r["n"] for r in items.collect())
    made = []
    for name in ("rebuild", "extend"):
        monkeypatch.setattr(TokenIndex, name, lambda self, *a, f=getattr(TokenIndex, name), n=name: made.append(n) or f(self, *a))
    for i in range(3):
        state.add_to_history(records(spark, sets(rng, 25, 1000 + 100 * i)), folder)
        index.follow(log)
        index.follow(log)  # nothing new
        assert left(items, index) == left(items, history=state.load_history(spark, folder))
    assert made == ["rebuild", "extend", "extend"]
    # a record that is replaced no longer counts
    state.add_to_history(records(spark, [(1000, "A", ["x1", "x2", "x3", "x4"])]), folder)
    index.follow(log)
    assert made[-1] == "rebuild" and left(items, index) == left(items, history=state.load_history(spark, folder))
    # neither does what the history has dropped
    state.save_history(state.load_history(spark, folder).limit(5), folder)
    index.follow(log)
    assert left(items, index) == left(items, history=state.load_history(spark, folder))


def test_only_young_sets_count(spark, tmp_path):
    index = TokenIndex(spark, f"file://{tmp_path}/index")
    same = [f"w{i}" for i in range(6)]
    old, none = records(spark, [(1, "A", same)], NOW - timedelta(days=20)), records(spark, [(2, "B", same)], None)
    index.rebuild(old.unionByName(none))
    items = spark.createDataFrame([(1, "A", same), (2, "B", same), (3, "C", same), (4, "A", same[:5]), (5, "A", []), (6, "A", None)], ITEMS)
    assert left(items, index, days=30) == [3, 5, 6] and left(items, index, days=10) == [1, 3, 4, 5, 6]
    index.extend(records(spark, [(3, "A", same)], NOW))  # sent again
    assert left(items, index, days=10) == [3, 5, 6]
    with pytest.raises(ValueError):
        index.against(NOW, 1)(items, None, 0.5)


def test_a_run_reads_the_folders_of_its_tokens_only(spark, tmp_path, monkeypatch):
    index = TokenIndex(spark, f"file://{tmp_path}/index")
    history = [(i, "A", [f"t{i}_{j}" for j in range(6)]) for i in range(400)]
    index.rebuild(records(spark, history))
    read, whole = [], TokenIndex._read
    monkeypatch.setattr(TokenIndex, "_read", lambda self, kind, buckets: read.append(whole(self, kind, buckets)) or read[-1])
    assert left(spark.createDataFrame([(1, "A", history[7][2]), (2, "A", ["n1", "n2", "n3", "n4"])], ITEMS), index) == [2]
    files = lambda df: sum(int("bucket=" in f) for f in df.inputFiles())
    for df in read:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all("bucket#" in scan[:80] for scan in plan.split("PartitionFilters: ")[1:]) and "PartitionFilters: " in plan
        assert df.count() < 400 * 6 / 2
    assert files(index.log.load()) > 60 and module.BUCKETS == 64


def test_the_run_through_the_index(spark, tmp_path):
    from newsloom.streaming.microbatch import start

    from .test_run import CONFIG, NOW, items

    rows = items(spark)
    for part, (name, some) in enumerate((("a", "item_ord < 2"), ("b", "item_ord >= 2 or item_ord = 0"))):
        rows.filter(some).write.parquet(f"{tmp_path}/in/{name}")
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        start(source, f"file://{tmp_path}/state", f"{tmp_path}/check", CONFIG, lambda: NOW, sink=f"{tmp_path}/sent", indexed=True).awaitTermination()
    assert sorted(r.item_ord for r in spark.read.parquet(f"{tmp_path}/sent").collect()) == [0, 1, 2, 3]
    assert TokenIndex(spark, f"file://{tmp_path}/state/index").log.current()[0] >= 1


def test_an_index_of_another_form_is_made_anew(spark, tmp_path, monkeypatch):
    rows = [(str(i), None, "u", "t", f"f{i}", [f"w{i}{j}" for j in range(6)], "A") for i in range(3)]
    state.add_to_history(spark.createDataFrame(rows, SEEN), str(tmp_path))
    log, index = state.history_log(spark, str(tmp_path)), TokenIndex(spark, f"{tmp_path}/index")
    monkeypatch.setattr(module, "FORM", 1)
    index.follow(log)
    monkeypatch.undo()
    index.follow(log)
    assert index.log.current()[0] == 2 and index.log.current()[1]["note"]["form"] == module.FORM
    index.follow(log)
    assert index.log.current()[0] == 2
