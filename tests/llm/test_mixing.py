import random
from fractions import Fraction
from itertools import product

from pyspark.sql import functions as F

from newsloom.llm import mixing

DATA = "/root/testdata/sf0.01"


def test_quotas():
    assert mixing.quotas([10, 10, 10], [1, 2, 3]) == [Fraction(5), Fraction(10), Fraction(15)]
    assert mixing.quotas([100, 1, 1], [1, 1, 1]) == [96, 3, 3]
    assert mixing.quotas([0, 5], [1, 1]) == [0, 5] and mixing.quotas([], []) == []


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        patterns = [(rng.randrange(4), rng.sample(range(2), rng.randrange(1, 3))) for _ in range(2)]
        quota = [rng.randrange(5) for _ in range(2)]
        flow = mixing.min_cost_flow(patterns, quota, 2)
        arcs = [(p, s) for p, (_, of) in enumerate(patterns) for s in of]

        def cost(f):
            out = 0
            for p, (words, _) in enumerate(patterns):
                n = sum(x for (q, _), x in f.items() if q == p)
                if n > 2 * words:
                    return None
                out += min(n, words) + 3 * max(0, n - words)
            return None if any(sum(x for (_, t), x in f.items() if t == s) > quota[s] for s in range(2)) else (-sum(f.values()), out)

        best = min(c for xs in product(range(5), repeat=len(arcs)) if (c := cost(dict(zip(arcs, xs)))) is not None)
        assert cost(flow) == best


def test_whole_table(spark):
    got = mixing.op3_mixing(spark, DATA).collect()
    again = mixing.op3_mixing(spark, DATA).collect()
    assert sorted(got) == sorted(again) and len(got) == 1000
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    by = {}
    for r in got:
        s = by.setdefault(source[r.doc_id], [0, 0, r.target, r.source_size])
        s[0] += r["size"]
        s[1] += r.taken
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
    # targets worked out by water-filling in whole hundredths of a word, apart from the operator
    order = sorted(by)
    weight, full, total = {s: 1 + i % 3 for i, s in enumerate(order)}, set(), sum(by[s][0] for s in order)
    while True:
        left, share = total - sum(3 * by[s][0] for s in full), sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and left * weight[s] > 3 * by[s][0] * share}
        if not more:
            break
        full |= more
    for s in order:
        t = 3 * by[s][0] if s in full else left * weight[s] / share
        assert by[s][0] == by[s][3] and abs(by[s][2] - t) < 1e-6 and abs(by[s][1] - t) <= 0.03 * t


def test_overlapping_sources_and_extra_columns(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b"] if i % 3 else ["c"], "x", 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>, lang string, size int")
    out = mixing.mixed(docs)
    assert set(docs.columns) | {"copies", "taken"} <= set(out.columns) and out.count() == 300
    sums = {tuple(r.source): (r.t, r.target) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()}
    assert all(abs(t - target) <= 7 for t, target in sums.values())


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "x y", None), (2, " ", "b"), (3, "x y z", "a"), (3, "x y z", "a"), (4, "u " * 500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 3, 3, 500] and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_plan_of_single_sources_is_that_of_quotas_and_flow(spark):
    rng = random.Random(4)
    for weights in (None, {"s3": 0.7, "s11": 2, None: 1.3, "none": 5}):
        sizes = {f"s{i}": rng.choice([0, 1, 3, 40, 900, 20_000]) for i in range(20)} | {None: 7}
        held = spark.createDataFrame([([k], n) for k, n in sizes.items()], "_of array<string>, size long")
        got = {r._of[0]: r for r in mixing.one_source_plan(held, weights, 3).collect()}
        order = sorted(sizes, key=lambda x: (x is None, x or ""))
        want = mixing.quotas([sizes[k] for k in order], [weights.get(k, 0) for k in order] if weights else [1 + i % 3 for i in range(len(order))])
        flow = mixing.min_cost_flow([(sizes[k], [i]) for i, k in enumerate(order)], [round(t) for t in want])
        for i, (k, t) in enumerate(zip(order, want)):
            r = got.pop(k)
            assert r.source_size == sizes[k] and r.target == float(t) and r._whole * sizes[k] + r._rest == flow.get((i, i), 0)
        assert not got


def test_one_source_for_each_of_very_many_hosts(spark):
    docs = spark.range(102_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lpad(F.col("id").cast("string"), 9, "0").alias("source"))
    got = mixing.mixed(docs).groupBy(F.col("doc_id") % 3, "target", "source_size", "taken").count().collect()
    # 102,000 sources of two words, weights 1, 2, 3: one, two and three words each; a text for one missing word is no nearer
    assert sorted(map(tuple, got)) == [(0, 1.0, 2, 0, 34_000), (1, 2.0, 2, 2, 34_000), (2, 3.0, 2, 2, 34_000)]


def test_networks_of_overlapping_sources_equal_one_flow(spark):
    rng = random.Random(8)
    names = [None, *(f"s{i}" for i in range(9))]
    held = {}
    for _ in range(25):
        k = rng.randrange(9)
        of = tuple(sorted({names[k], names[k // 2 * 2 % 10], *rng.sample(names[:3], rng.randrange(2))} if rng.random() < 0.7 else {names[k]}, key=lambda x: (x is None, x or "")))
        held[of] = rng.choice([0, 5, 60, 700])
    held[()] = 40
    got = {tuple(r._of): r._whole * r.source_size + r._rest for r in mixing.network_plan(spark.createDataFrame([(list(k), n) for k, n in held.items()], "_of array<string>, size long"), None, 3).collect()}
    every = sorted({s for of in held for s in of}, key=lambda x: (x is None, x or ""))
    sizes = [sum(n for of, n in held.items() if s in of) for s in every]
    target = mixing.quotas(sizes, [1 + i % 3 for i in range(len(every))])
    part = min(1, sum(held.values()) / float(sum(target)))
    quota = [int(float(t) * part + 0.5) for t in target]
    patterns = sorted(held, key=lambda of: [(s is None, s or "") for s in of])
    flow = mixing.min_cost_flow([(held[of], [every.index(s) for s in of]) for of in patterns], quota)
    assert got.keys() == held.keys()
    cost = lambda gives: sum(min(g, held[of]) + 3 * max(0, min(g, 2 * held[of]) - held[of]) + 9 * max(0, g - 2 * held[of]) for of, g in gives.items())
    want = {of: sum(n for (p, _), n in flow.items() if patterns[p] == of) for of in patterns}
    assert sum(got.values()) == sum(want.values()) and cost(got) == cost(want)


def test_many_equal_rows_do_not_miss_the_target(spark):
    rows = [(None, "a", "ten words of text that stand here for a while")] * 3000 + [(i, "b", f"other words {i} of a text that is as long") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for docs in (frame, frame.withColumn("lang", frame.source)):
        by = {}
        for r in mixing.mixed(docs, {"a": 5, "b": 3}).select("source", "size", "target", "taken").collect():
            assert r.taken % r.size == 0 and r.taken <= 3 * r.size
            by.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert all(abs(target - taken) <= 10 for target, taken in by.values()) and len(by) == 2


def test_flow_of_many_patterns_ends():
    import random
    import time

    rng, began = random.Random(4), time.time()
    patterns = [(rng.randrange(1, 1000), sorted(rng.sample(range(40), rng.randrange(1, 6)))) for _ in range(20_000)]
    total = sum(n for n, _ in patterns)
    flow = mixing.min_cost_flow(patterns, [total // 40] * 40)
    assert sum(flow.values()) >= total // 40 * 40 * 0.99 and time.time() - began < 60
