from pathlib import Path

import numpy as np
import xxhash

from newsloom.llm import simhash

DATA = "/root/testdata/sf0.001"


def brute(texts):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        for blank in "\t\n\x0b\x0c\r":
            w = w.replace(blank, " ")
        w = [x for x in w.split(" ") if x]
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return out


def roots(fps, ids, limit=4):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    fps = brute([d.text for d in docs])
    want = {d.doc_id: (f"{f:016x}", r) for d, f, r in zip(docs, fps, roots(fps, [d.doc_id for d in docs]))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, DATA).collect()}
    assert got == want


def test_long_texts_in_pieces():
    texts = ["A bc  d e f g", "a", "a b c", "", " \n", "word " * 300 + "x", "y" * 500 + " z q w"]
    for t, want in zip(texts, brute(texts)):
        for prints in (1, 3):
            found = [simhash.fingerprint(t.encode(), piece=n, prints=prints) for n in (1, 7, 64, 1 << 19)]
            assert {int(f[0]) & (2**64 - 1) for f in found} == {want} and all((f == found[0]).all() for f in found)


def test_links_of_clustered_fingerprints(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for _ in range(500):
        fps.append(fps[rng.integers(len(fps))] ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))))
    fps = list(dict.fromkeys(fps))
    ids = list(range(len(fps)))
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    from newsloom.llm.common import components

    for block, limit in ((20_000, 4), (3, 4), (20_000, 6), (5, 7)):
        want = roots(fps, ids, limit)
        found = {int(np.int64(r.node).astype(np.uint64)): int(np.int64(r.root).astype(np.uint64)) for r in components(simhash.links(frame, block, limit)).collect()}
        mine = {}
        for f, w in zip(fps, want):
            mine.setdefault(found.get(f, f), set()).add(w)
        assert all(len(x) == 1 for x in mine.values()) and len(mine) == len(set(want))


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n", 7), (None, "a b c d e", 7), (5, "A B C D E", 7), (5, "A B C D E", 7), (6, "x " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 5), (1, 1), (2, 1), (3, 1), (5, 5), (5, 5), (6, 6)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_several_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 120))) for _ in range(60)]
    for _ in range(240):
        w = texts[rng.integers(60)].split()
        for _ in range(rng.integers(0, 6)):
            if w:
                w[rng.integers(len(w))] = str(rng.choice(words))
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = np.array([simhash.fingerprint(t.encode(), 5, prints=3) for t in texts])
    near = (np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)) <= 6).any(2)
    root = list(range(300))
    for _ in range(300):
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(300)]
        if new == root:
            break
        root = new
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5, prints=3, limit=6).collect()}
    assert got == dict(enumerate(root)) and 60 < len(set(root)) < 300
    assert len(set(root)) < len({r.component_id for r in simhash.near_duplicates(docs, words=5, limit=6).collect()})
