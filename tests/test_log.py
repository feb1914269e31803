import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest
from pyspark.sql import types as T

from newsloom.sources import log, state
from newsloom.sources.log import CommitLog, Conflict

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType())])


@pytest.fixture
def made(spark, tmp_path):
    return CommitLog(spark, f"file://{tmp_path}/log", SCHEMA, "id")


def rows(log, *pairs):
    return log.spark.createDataFrame(list(pairs), SCHEMA)


def held(log):
    return sorted((r["id"], r["v"]) for r in log.load().collect())


def test_later_parts_replace_earlier_ones(made):
    assert held(made) == [] and made.current()[0] == 0
    assert made.commit(rows(made, ("a", 1), ("b", 1))) == 1
    assert made.commit(rows(made, ("b", 2), ("c", 2))) == 2
    made.commit(rows(made, ("c", 3)))
    assert held(made) == [("a", 1), ("b", 2), ("c", 3)]
    made.commit(rows(made, ("z", 9)), whole=True)
    assert held(made) == [("z", 9)]


def test_records_without_key_stay(made):
    made.commit(rows(made, (None, 1), ("a", 1)))
    made.commit(rows(made, (None, 2), ("a", 2)))
    assert sorted(map(str, ((r["id"], r["v"]) for r in made.load().collect()))) == sorted(map(str, [(None, 1), (None, 2), ("a", 2)]))


def test_the_second_of_two_writers_is_told(made):
    number, _ = made.current()
    made.commit(rows(made, ("a", 1)), number)
    with pytest.raises(Conflict):
        made.commit(rows(made, ("b", 1)), number)
    assert held(made) == [("a", 1)]


def test_a_number_is_put_once(made):
    made.commit(rows(made, ("a", 1)))
    with pytest.raises(Conflict):
        made._put(1, {"version": 1, "parts": []})
    assert held(made) == [("a", 1)] and all(n.endswith(".json") for n in made._names("_log"))


def test_writers_at_once_lose_nothing(made):
    def write(k):
        own = CommitLog(made.spark, made.folder, SCHEMA, "id")
        for i in range(2):
            own.change(lambda _: rows(own, (f"{k}-{i}", k)), attempts=50)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    assert held(made) == sorted((f"{k}-{i}", k) for k in range(3) for i in range(2)) and made.current()[0] == 6


def test_a_change_is_made_anew_after_a_conflict(made):
    made.commit(rows(made, ("n", 1)))
    seen = []

    def more(now):
        seen.append(now.first()["v"])
        if len(seen) == 1:  # another writer comes between
            made.commit(rows(made, ("n", 10)))
        return rows(made, ("n", seen[-1] + 1))

    made.change(more, whole=True)
    assert seen == [1, 10] and held(made) == [("n", 11)]
    with pytest.raises(Conflict):
        made.change(lambda now: made.commit(rows(made, ("x", 0))) and now, attempts=1)


def test_a_crash_at_each_step_leaves_the_last_version(made, tmp_path):
    made.commit(rows(made, ("a", 1)))
    before = held(made)
    # while the part is written: files without a commit
    rows(made, ("x", 1)).write.parquet(f"{made.folder}/data/half")
    os.remove(f"{tmp_path}/log/data/half/_SUCCESS")
    assert held(made) == before
    # while the commit is written: it has another name until it is whole
    (tmp_path / "log/_log/.half").write_text('{"version": 2, "par')
    assert held(made) == before and made.current()[0] == 1
    # where a store has left a broken commit: its number is taken, the one below counts
    (tmp_path / "log/_log/00000000000000000002.json").write_text('{"version": 2, "par')
    assert held(made) == before and made.current()[0] == 2
    made.commit(rows(made, ("b", 3)))
    assert held(made) == [("a", 1), ("b", 3)] and made.current()[1]["version"] == 3


def test_parts_and_versions_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "PARTS", 4)
    clock = [0.0]
    import time

    made = CommitLog(spark, f"file://{tmp_path}/log", SCHEMA, "id", kept=lambda df: df.filter("v > 2"), clock=lambda: clock[0])
    for i in range(14):
        clock[0] = time.time() + 1e5 * (i + 1)  # all that stands is old by now
        made.commit(rows(made, (f"k{i % 6}", i)))
    taken = made.versions()
    assert len(taken) <= log.VERSIONS and taken[-1] == 14
    assert len(made.current()[1]["parts"]) <= 5 and len(made._names("data")) <= log.VERSIONS * 6
    assert held(made) == sorted((f"k{i % 6}", i) for i in range(8, 14))


def test_young_files_are_left_alone(made):
    for i in range(9):
        made.commit(rows(made, (f"k{i}", i)))
    made._part(rows(made, ("in the making", 0)))
    made.clean()
    assert len(made.versions()) == 9 and len(made._names("data")) == 10


def test_history_between_a_crash_and_the_next_run(spark, tmp_path):
    folder, now = f"file://{tmp_path}", datetime(2026, 8, 1, tzinfo=timezone.utc)
    record = lambda i: spark.createDataFrame([(i, now, "u", "t", "f", ["a"], "CRISE")], state.SEEN)
    state.add_to_history(record("1"), folder)
    record("2").write.parquet(f"{folder}/outbox")
    # the run dies before the history is extended: the outbox still tells
    assert {r["id"] for r in state.with_outbox(state.load_history(spark, folder), folder).collect()} == {"1", "2"}
    # it dies between the commit and the clearing: repeating changes nothing
    state.add_to_history(state.outbox(spark, folder), folder)
    state.settle(spark, folder)
    assert sorted(r["id"] for r in state.load_history(spark, folder).collect()) == ["1", "2"] and state.outbox(spark, folder) is None
    with pytest.raises(Conflict):
        state.save_history(record("3"), folder, expected=1)
