import zlib

import numpy as np
import pyarrow as pa

from newsloom.llm import quality_knn as q

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in q.op8_quality_knn(spark, DATA).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    mine = [(got[k].score, n) for k, n in labels.items() if got[k].held_out]
    good, bad = [s for s, n in mine if n], [s for s, n in mine if not n]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95 and np.mean([(s >= 0.3) == bool(n) for s, n in mine]) > 0.95


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    x, v, n = rng.standard_normal((7, 5)), rng.standard_normal((30, 5)), rng.integers(0, 2, 30)
    x, v = x / np.linalg.norm(x, axis=1, keepdims=True), v / np.linalg.norm(v, axis=1, keepdims=True)
    for row, got in zip(x, q.votes(x, v, n, 4, 2)):
        near = sorted(range(30), key=lambda i: -(row @ v[i]))[:4]
        w = [max(0, row @ v[i]) ** 2 for i in near]
        assert abs(got - (sum(a * n[i] for a, i in zip(w, near)) + 0.1 * n.mean()) / (sum(w) + 0.1)) < 1e-9


def test_counts_do_not_cross_rows_or_pieces():
    texts = ["ab c", None, "", "ab c!" * 900_000, "x"]
    got = q.term_counts(pa.array([t and t.encode() for t in texts], pa.binary()))
    for t, row in zip(texts, got):
        alone = q.term_counts(pa.array([t and t.encode()], pa.binary()))[0]
        assert np.array_equal(row, alone)
        assert row[:1024].sum() == max(0, len(t or "") - 1) and row[1024:2024].sum() == max(0, len(t or "") - 2)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 5.0), (2, None, 1.0), (None, "", 1.0), (3, "BAD!! BAD!!", 0.0), (3, "BAD!! BAD!!", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (3, None), (2, None)], "doc_id long, quality int")
    out = q.scored(docs, labels)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"] or set(out.columns) == {"doc_id", "text", "held_out", "score", "predicted"}
    assert out.count() == 5 and all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in q.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert q.scored(docs.limit(0), labels).count() == 0
