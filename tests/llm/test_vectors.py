import math

import numpy as np
import pytest

from newsloom.llm import ann_forest, topk_search


def odd_frame(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(120)]
    rows += [(i, rows[5][1]) for i in range(200, 260)]  # one very common vector
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (320, [0.0] * 6), (340, []), (360, [1.0, 2.0]), (0, rows[0][1])]
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int"), rows


def whole(rows, zeros):
    out = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zeros and not any(v)):
            continue
        out[i] = np.array(v + [0.0] * (6 - len(v)))
    return out


def test_exact_search_against_brute_force(spark):
    frame, rows = odd_frame(spark)
    kept = {i: np.floor(64 * v).astype(int) for i, v in whole(rows, True).items()}
    want = set()
    for q in (i for i in kept if i % 20 == 0):
        best = sorted(((-int(kept[q] @ v), i) for i, v in kept.items() if i != q))[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for sizes in ({}, {"block": 3, "slice_rows": 50}):
        assert {tuple(r) for r in topk_search.search(frame, lambda i: i % 20 == 0, **sizes).collect()} == want
    assert topk_search.search(frame.limit(0), lambda i: i % 20 == 0).count() == 0


def test_huge_components(spark):
    frame = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 0.0]), (2, [2.5e6, 5.0]), (3, [-3e6, 0.5]), (20, [0.0, 1e12])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.search(frame, lambda i: i % 20 == 0).collect()}
    v = {0: (192_000_000, 64), 1: (192_000_000, 0), 2: (160_000_000, 320), 3: (-192_000_000, 32), 20: (0, 64 * 10**12)}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    for q in (0, 20):
        best = sorted(((-dot(q, i), i) for i in v if i != q))
        assert [got[q, n + 1] for n in range(4)] == [(i, -s) for s, i in best]
    assert got[0, 1] == (1, 36_864_000_000_000_000) and got[0, 2] == (2, 30_720_000_000_020_480) and len(got) == 8
    # no score of 64 bits: an error, not a wrong number
    with pytest.raises(Exception, match="OverflowError|too large"):
        topk_search.search(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>"), lambda i: i == 0).collect()


def test_clustered_rows_are_handed_to_few_blocks(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((50, 16))
    rows = []
    for i in range(6000):
        x = centre[i // 7 % 50] + 0.02 * rng.standard_normal(16)
        rows.append((i, [float(y) for y in x / np.linalg.norm(x)]))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = topk_search.handout(frame, lambda i: i % 20 == 0, scale=4096)
    assert plan.blocks > 10 and plan.data.count() / (6000 * plan.blocks) < 0.1
    got = {tuple(r) for r in topk_search.search(frame, lambda i: i % 20 == 0, k=3, scale=4096).collect()}
    v = np.array([np.floor(4096 * np.array(x)) for _, x in rows]).astype(int)
    want = set()
    for q in range(0, 6000, 20):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(6000), -s)) if i != q][:3]
        want |= {(q, n + 1, int(i), int(s[i])) for n, i in enumerate(best)}
    assert got == want


def test_rows_of_unlike_norms_and_parted_homes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(3) * 0.1 + (i % 2) * 50]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows}
    want = set()
    for q in range(0, 2000, 101):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:3]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for sizes in ({}, {"block": 2, "slice_rows": 300, "most_pivots": 5}):
        assert {tuple(r) for r in topk_search.search(frame, lambda i: i % 101 == 0, k=3, **sizes).collect()} == want


def test_forest_recall_and_distances(spark):
    for data in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        got = ann_forest.op6_ann_forest(spark, data).collect()
        rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
        found = {}
        for r in got:
            assert abs(r.score - np.sqrt(((rows[r.query_id] - rows[r.vec_id]) ** 2).sum())) < 1e-12
            found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        hits = total = 0
        for q in (i for i in rows if i % 100 == 0):
            best = sorted((np.sqrt(((rows[q] - v) ** 2).sum()), i) for i, v in rows.items() if i != q)[:10]
            mine = sorted(found[q])
            assert [x[0] for x in mine] == list(range(1, 11)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
            hits += len({i for _, i in best} & {i for *_, i in mine})
            total += 10
        assert hits / total >= 0.9


def test_forest_odd_rows(spark):
    frame, rows = odd_frame(spark)
    kept = whole(rows, False)
    got = ann_forest.search(frame, lambda i: i % 20 == 0, reach=math.inf).collect()
    want = set()
    for q in (i for i in kept if i % 20 == 0):
        best = sorted((float(np.sqrt(((kept[q] - v) ** 2).sum())), i) for i, v in kept.items() if i != q)[:10]
        want |= {(q, n + 1, i) for n, (_, i) in enumerate(best)}
    assert {tuple(r)[:3] for r in got} == want
    assert ann_forest.search(frame, lambda i: i % 20 == 0).count() > 0
    assert ann_forest.search(frame.limit(0), lambda i: i % 20 == 0).count() == 0


def test_ascent_stops_when_it_has_enough():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 16))
    forest = ann_forest.Forest(x, x.mean(0), 3, trees=8)
    first, end = forest.spans(forest.strings(x[:20]))
    for reach in (1, 40, 200, 10_000):
        depth, trees = forest.stops(first, end, reach)
        for i in range(20):
            n = end[:, :, i] - first[:, :, i]
            steps = [(d, t) for d in (3, 2, 1) for t in range(1, 9)]
            met = [n[d, :t].sum() + (n[d + 1, t:].sum() if d < 3 else 0) for d, t in steps]
            at = next((s for s, m in zip(steps, met) if m >= reach), (0, 8))
            assert (depth[i], trees[i]) == at
            rows = forest.matches(first, end, i, depth[i], trees[i])
            assert i in rows and (reach < 10_000 or len(rows) == 500)


def exact(rows, queries, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        out[q] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def test_every_query_gets_its_answers_on_clusters_and_copies(spark):
    for blur in (0.0, 1e-3):
        rng = np.random.default_rng(2)
        rows, group = [], None
        for i in range(6000):
            if i % 15 == 0:
                group = rng.standard_normal(32)
            rows.append((i, (rng.standard_normal(32) if i % 100 == 0 else group + blur * rng.standard_normal(32)).tolist()))
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = {}
        for r in ann_forest.search(frame, lambda i: i % 100 == 0).collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
        want = exact(rows, range(0, 6000, 100))
        assert {len(x) for x in found.values()} == {10} and len(found) == 60 and all(len(set(x)) == 10 for x in found.values())
        # equally near copies are as good as each other but for the order of ties, which the answers keep
        assert sum(len(set(want[q]) & set(found[q])) for q in want) / 600 >= 0.9


def test_few_candidates_are_all_answers(spark):
    rows = [(i, [float(i == j) for j in range(8)]) for i in range(8)] + [(100, [1.0] * 8), (200, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann_forest.search(frame, lambda i: i % 100 == 0, reach=0.0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(x) for q, x in found.items()} == {0: 9, 100: 9, 200: 9}
