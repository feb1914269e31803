import random

from pyspark.sql import functions as F

from newsloom.llm import common


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(900, i) for i in range(901, 1100)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(20), i, rng.randrange(50)) for i in range(500)]
    got = {(r.k, r.i): (r.row_no, r.sum_before) for r in common.prefix_sums(spark.createDataFrame(rows, "k long, i long, n long"), ["k", "i"], "n").collect()}
    total = 0
    for place, (k, i, n) in enumerate(sorted(rows)):
        assert got[k, i] == (place, total)
        total += n


def test_words(spark):
    texts = [None, "", " \t\n", "a", " a  b\nc ", "a b c"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.word_count(F.col("t")).alias("n")).collect()]
    assert got == [0, 0, 0, 1, 3, 2]


def test_work_folder_is_the_sessions(spark):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_staged_leaves_only_its_result(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    out = common.staged(spark, lambda: common.staged(spark, lambda: common.written(spark.range(5)).filter("id > 1")).filter("id < 4"))
    assert sorted(r.id for r in out.collect()) == [2, 3] and len(os.listdir(tmp_path)) == 1
